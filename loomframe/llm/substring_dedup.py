"""Substring dedup by hashing the units of lines, over the whole corpus.

A unit is a line or a sentence of one (after . ! ? before white space), compared with case folded
and white space collapsed. Digests are counted globally; of equal units the one with the lowest
(doc_id, place) stays. In each document, neighbouring units that occur earlier elsewhere form runs
(blank units neither break nor count); a run of `least_words` words or more is removed, shorter ones
stay, so short stock lines and clean documents are left alone. Removed spans keep the offsets of the
original text (code points).

With `anywhere`, passages need no unit edges: every run of `least_words` words that equals an earlier
one (lowest doc_id, then place) marks its words, wherever it stands in a line; words of repeated units
are marked too, and each run of `least_words` marked words or more is removed. Repeats that overlap
what they repeat, as in one word said over and over, are one occurrence. Windows of `least_words`
words are named by the least hash of the half windows in them, so that a name stands for about 7
windows; the windows of one occurrence of a name go together as one piece. Only pieces whose name is
repeated are shuffled, and only the first of equal pieces is taken apart into windows, if an unlike
piece has its name. No window is left out by this: equal windows have one name.

Three passes read the texts: 64-bit digests are counted and the repeated ones mark a fixed-size bit
map; units whose bit is marked (a few false ones are harmless) are grouped by 128-bit digest; spans
are cut. Only repeated units and their places are shuffled besides the counts, and the joins that
send places back have a plain exchange on both sides, so that a hot line's rows can be split.

Defined results: a null text stays null with no spans, an empty one empty; rows with a null doc_id
neither lose text nor make others lose it; rows that share a doc_id are told apart by a digest of
their text, and of equal units at one place of them each stays; repeats within a document are removed like those
across documents; texts of any length are whole; an empty table gives an empty table; all input
columns are kept, whatever their names, but those of the results (any case: ValueError).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomframe.llm.common import dropped, mixed, sliced, split_words, written
from loomframe.llm.jaccard_join import map_bits, marked, marks

LEAST_WORDS = 25
BREAK = re.compile(r"(?<=[.!?])(?=[\x20\x09\x0B-\x0D])|(?<=\n)")
OWN = ["clean_text", "spans", "n_units", "n_removed", "removed_words"]


def units(text: str) -> tuple[list[str], list[bytes]]:
    """The pieces of a text, which joined give the text, and their normal forms (blank: empty)."""
    pieces = BREAK.split(text)
    return pieces, [b" ".join(p.lower().encode("utf-8", "surrogatepass").split()) for p in pieces]


def digest64(form: bytes) -> int:
    return xxhash.xxh3_64_intdigest(form)


def runs(repeated: set[int], forms: list[bytes], least_words: int) -> list[tuple[int, int, int]]:
    """(first unit, last unit, words) of each run to remove."""
    out: list[tuple[int, int, int]] = []
    first = last = -1
    words = 0
    for k, form in enumerate(forms):
        if not form:
            continue
        if k in repeated:
            first, last, words = (k if first < 0 else first), k, words + form.count(b" ") + 1
        elif first >= 0:
            out.append((first, last, words))
            first, words = -1, 0
    if first >= 0:
        out.append((first, last, words))
    return [r for r in out if r[2] >= least_words]


def cut(text: str, repeated: set[int], least_words: int) -> tuple[str, list[tuple[int, int]], int, int, int]:
    """(clean text, spans, units, removed units, removed words) of a text."""
    pieces, forms = units(text)
    ends = np.cumsum([0, *map(len, pieces)]).tolist()
    spans, gone, words, kept, at = [], 0, 0, [], 0
    for first, last, n in runs(repeated, forms, least_words):
        spans.append((ends[first], ends[last + 1]))
        kept.append(text[at : ends[first]])
        at = ends[last + 1]
        gone += sum(1 for k in range(first, last + 1) if forms[k])
        words += n
    return "".join([*kept, text[at:]]), spans, sum(1 for f in forms if f), gone, words


def map_of(values: DataFrame) -> np.ndarray:
    """The map of the values' bits, its size after their number."""
    table = written(values, "repeated")
    out = marks(table, map_bits(table.count()))
    dropped(table)
    return out


def repeated_units(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, places): the units of each text that an earlier unit equals; mark is the text's digest."""
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found = [digest64(f) for t in batch.column("text").to_pylist() if t for f in units(t)[1] if f]
            values, n = np.unique(np.array(found, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["h", "n"])

    often = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    shared = spark.sparkContext.broadcast(map_of(often))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            owner, place, forms = [], [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                for k, f in enumerate(units(t)[1] if t else ()):
                    if f:
                        owner.append(i)
                        place.append(k)
                        forms.append(f)
            hit = np.flatnonzero(marked(shared.value, np.array([digest64(f) for f in forms], np.uint64))) if forms else []
            long = [xxhash.xxh3_128_intdigest(forms[i]) for i in hit]
            signed = [[x - (1 << 64) if x >> 63 else x for x in xs] for xs in ([v >> 64 for v in long], [v & ((1 << 64) - 1) for v in long])]
            yield pa.RecordBatch.from_arrays([pa.array(signed[0], pa.int64()), pa.array(signed[1], pa.int64()), *[batch.column(c).take(pa.array([owner[i] for i in hit], pa.int32())) for c in ("doc_id", "mark")], pa.array([place[i] for i in hit], pa.int32())], ["h1", "h2", "doc_id", "mark", "place"])

    found = written(docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(pick, "h1 long, h2 long, doc_id long, mark long, place int"), "units")
    first = found.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "place")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # The bits of h1 are flipped so that the join does not reuse the grouping's partitioning and can split hot digests.
    first = first.select(F.bitwise_not("h1").alias("g1"), F.col("h2").alias("g2"), F.col("first.doc_id").alias("d"), F.col("first.place").alias("p"))
    later = found.withColumn("g1", F.bitwise_not("h1")).withColumn("g2", F.col("h2")).join(first, ["g1", "g2"]).where("doc_id != d or place != p")
    out = written(later.groupBy("doc_id", "mark").agg(F.collect_set("place").alias("places")), "places")
    dropped(found)
    return out


# Passages without unit edges ----------------------------------------------------------------------


def rolled(hashes: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A hash of each `width` neighbouring values, by doubling."""
    out, n = mixed(hashes ^ np.uint64(seed)), 1
    while n < width:
        step = min(n, width - n)
        out = mixed(out[:-step] * np.uint64(0x9E3779B97F4A7C15) + out[step:])
        n += step
    return out


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring values, by doubling."""
    n = 1
    while n < width:
        step = min(n, width - n)
        values = np.minimum(values[:-step], values[step:])
        n += step
    return values


def pieces(texts: list[str | None], width: int) -> tuple[np.ndarray, ...]:
    """(row, place, windows, start, name, windows' hashes from a piece's `at` on): the pieces of texts.

    A name's run of neighbouring windows starts at `start`; it is cut after as many windows as one half
    window can name, so a run that is longer has as many pieces as the name has occurrences at least.
    """
    half = (width + 1) // 2
    most = width - half + 1
    offsets, words = split_words(pa.array([t.lower() if t else "" for t in texts], pa.string()))
    empty = np.zeros(0, np.int64)
    if len(words) < width:
        return empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64), empty
    coded = words.dictionary_encode()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    hashes = known[np.asarray(coded.indices)]
    name, whole = least(rolled(hashes, half, 1), most), rolled(hashes, width, 2)
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))[: len(name)]
    inside = np.arange(len(name)) + width <= offsets[1:][row]
    fresh = np.ones(len(name), bool)
    fresh[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(name)), 0))
    at = np.flatnonzero(inside & ((np.arange(len(name)) - begin) % most == 0))
    # A piece ends where the next one of its text starts, or with the last window of the text.
    last = offsets[1:][row[at]] - width + 1
    after = np.minimum(np.append(at[1:], len(name)), last)
    return row[at], at - offsets[row[at]], after - at, begin[at] - offsets[row[at]], name[at], whole, at


def repeated_windows(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, mark, covers): from each place (in words) of a text, how many windows equal an earlier one."""
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            values, n = np.unique(pieces(batch.column("text").to_pylist(), width)[4], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], ["h", "n"])

    often = docs.where("doc_id is not null").select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    shared = spark.sparkContext.broadcast(map_of(often))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            row, place, n, start, name, whole, at = pieces(batch.column("text").to_pylist(), width)
            hit = np.flatnonzero(marked(shared.value, name))
            row, place, n, start, name, at = (x[hit] for x in (row, place, n, start, name, at))
            key = mixed(mixed(whole[at] + n.astype(np.uint64)) + whole[at + n - 1]) if len(at) else name
            # Equal pieces of a text that overlap are one occurrence, which starts with the first.
            order = np.lexsort((place, key, name, row))
            r, p, k, m = row[order], place[order], key[order], name[order]
            new = np.ones(len(order), bool)
            new[1:] = (r[1:] != r[:-1]) | (m[1:] != m[:-1]) | (k[1:] != k[:-1]) | ((p[1:] - p[:-1] >= width) & (start[order][1:] != start[order][:-1]))
            head = np.empty(len(order), np.int64)
            head[order] = start[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
            ends = np.concatenate([[0], np.cumsum(n)])
            own = np.repeat(at - ends[:-1], n) + np.arange(ends[-1])
            windows = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(whole[own].view(np.int64)))
            ids = [batch.column(c).take(pa.array(row, pa.int32())) for c in ("doc_id", "mark")]
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(key.view(np.int64)), *ids, pa.array(head, pa.int32()), pa.array(place, pa.int32()), pa.array(n, pa.int32()), windows], ["h1", "h2", "doc_id", "mark", "head", "place", "n", "w"])

    found = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("mark"), "text")
    found = written(found.mapInArrow(pick, "h1 long, h2 long, doc_id long, mark long, head int, place int, n int, w array<long>"), "pieces")
    kinds = found.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "mark", "head", "place")).alias("first"), F.count(F.lit(1)).alias("c"))
    kinds = written(kinds, "kinds")
    several = kinds.groupBy("h1").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(F.bitwise_not("h1").alias("g0"))
    # As in repeated_units, flipped bits give the joins plain exchanges on both sides.
    kinds_of = kinds.withColumn("g0", F.bitwise_not("h1")).join(several.withColumn("mixed", F.lit(True)), "g0", "left").where("c > 1 or mixed")
    kinds_of = kinds_of.select(F.bitwise_not("h2").alias("g2"), F.col("h1").alias("g1"), "first", F.coalesce("mixed", F.lit(False)).alias("mixed"))
    rows = found.withColumn("g2", F.bitwise_not("h2")).withColumn("g1", F.col("h1")).join(kinds_of, ["g2", "g1"])
    leads = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark")) & (F.col("place") == F.col("first.place"))
    again = ~((F.col("doc_id") == F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark")) & (F.col("head") == F.col("first.head")))
    rows = rows.select("h1", "doc_id", "mark", "head", "place", "n", again.alias("again"), F.when(leads & F.col("mixed"), F.col("w")).alias("w"))
    rows = written(rows.where("again or w is not null"), "hits")
    dropped(found, kinds)
    apart = rows.where("w is not null").select("h1", "doc_id", "mark", "head", "place", F.posexplode("w").alias("i", "w"))
    apart = written(apart.select("h1", "w", "doc_id", "mark", "head", (F.col("place") + F.col("i")).alias("place")), "windows")
    first = apart.groupBy("h1", "w").agg(F.min(F.struct("doc_id", "mark", "place", "head")).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    first = first.select(F.bitwise_not("w").alias("g2"), F.col("h1").alias("g1"), "first")
    later = apart.withColumn("g2", F.bitwise_not("w")).withColumn("g1", F.col("h1")).join(first, ["g2", "g1"])
    near = (F.col("place") - F.col("first.place") < width) | (F.col("head") == F.col("first.head"))
    later = later.where(~((F.col("doc_id") == F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark")) & near))
    covers = rows.where("again").select("doc_id", "mark", "place", "n").union(later.select("doc_id", "mark", "place", F.lit(1).alias("n")))
    out = written(covers.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("place", "n")).alias("covers")), "covers")
    dropped(rows, apart)
    return out


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut_words(text: str, repeated: set[int], covers: list[tuple[int, int]], least_words: int) -> tuple[str, list[tuple[int, int]], int, int, int]:
    """As cut, with the words of windows that start at covers; n_removed counts the units that lose words.

    A run's edge that is a unit's is cut there, any other at the edge of its word.
    """
    parts, forms = units(text)
    ends = np.cumsum([0, *map(len, parts)]).tolist()
    sizes = [f.count(b" ") + 1 if f else 0 for f in forms]
    upto = np.cumsum([0, *sizes])
    gone = np.zeros(int(upto[-1]) + 1, np.int64)
    for place, n in covers:
        gone[place] += 1
        gone[place + n + least_words - 1] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    for k in repeated:
        gone[upto[k] : upto[k + 1]] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    spans, kept, at, lost, words = [], [], 0, 0, 0
    places = [m.span() for m in WORD.finditer(text)] if len(edges) else []
    solid = [k for k, n in enumerate(sizes) if n]
    starts = {int(upto[k]): ends[k] for k in solid}
    stops = {int(upto[k + 1]): ends[k + 1] for k in solid}
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if b - a < least_words:
            continue
        lo, hi = starts.get(a, places[a][0]), stops.get(b, places[b - 1][1])
        spans.append((lo, hi))
        kept.append(text[at:lo])
        at = hi
        lost += int(np.searchsorted(upto, b, "left") - np.searchsorted(upto, a, "right") + 1 - np.count_nonzero(np.array(sizes[int(np.searchsorted(upto, a, "right")) - 1 : int(np.searchsorted(upto, b, "left"))]) == 0))
        words += b - a
    return "".join([*kept, text[at:]]), spans, len(solid), lost, words


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, anywhere: bool = False) -> DataFrame:
    """docs with clean_text, spans (array of start and end), n_units, n_removed and removed_words."""
    clash = set(OWN) & {c.lower() for c in docs.columns}
    if clash:
        raise ValueError(f"the input already has {sorted(clash)}")
    names = docs.columns
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    places = repeated_units(slim)
    if anywhere:
        places = places.join(repeated_windows(slim, least_words), ["doc_id", "mark"], "full")
    else:
        places = places.withColumn("covers", F.lit(None).cast("array<struct<place:int,n:int>>"))
    # The row's other columns travel as one, so that no name of theirs can clash with what is joined.
    others = [c for c in names if c != text]
    rows = docs.select(F.struct(F.lit(0), *[F.col(f"`{c}`") for c in others]).alias("row"), F.col(f"`{text}`").alias("text"), F.col(f"`{doc_id}`").cast("long").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("of"))
    found = places.select(F.col("doc_id").alias("key"), F.col("mark").alias("of"), "places", "covers")
    rows = rows.join(found, ["key", "of"], "left").select("row", "text", "places", "covers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            found = zip(*[batch.column(c).to_pylist() for c in ("text", "places", "covers")])
            got = [(None, [], 0, 0, 0) if t is None else cut_words(t, set(p or ()), [(c["place"], c["n"]) for c in cs], least_words) if cs else cut(t, set(p or ()), least_words) for t, p, cs in found]
            spans = pa.array([[{"start": a, "end": b} for a, b in g[1]] for g in got], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            more = [pa.array([g[0] for g in got], pa.string()), spans, *[pa.array([g[k] for g in got], pa.int64()) for k in (2, 3, 4)]]
            fields = dict(zip(others, batch.column("row").flatten()[1:])) | {text: batch.column("text")}
            yield pa.RecordBatch.from_arrays([*[fields[c] for c in names], *more], [*names, *OWN])

    more = "clean_text string, spans array<struct<start:bigint,end:bigint>>, n_units long, n_removed long, removed_words long"
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(more).fields])
    return rows.mapInArrow(run, schema)
