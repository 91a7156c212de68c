"""Best-fit packing of token sequences, bulk-synchronous.

Documents are tokenised and cut into pieces of at most `size` tokens. Pieces are range-sorted by
length; each gets its rank among the pieces of its length, which is exact however skewed lengths
are. Gaps and lengths are integers of at most `size`, so the supersteps run over size classes and
intervals of ranks instead of rows: in each, the longest unplaced class meets its successor among
the gaps (the smallest gap that holds it), ranks decide which pieces get the gaps when one side is
short, the gaps that took a piece shrink, and what is left goes on. This is best-fit decreasing,
and its plan has a bounded size whatever the corpus. Pieces then look up their interval.

Tokenising goes by distinct white-space-separated chunks: the tokenizer's splits never cross white
space, which tests compare with whole-text encoding.

Defined results: null or empty text is one piece that holds the end id alone; texts of any length
are whole; a null doc_id is one like any other; repeated rows are packed each; an empty table gives an empty table; ranks of ties are
fixed by the written order; other columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import REMEMBERED, dropped, sliced, split_words, written

SIZE, END_ID = 2048, 0
TOKENIZER = "word_bpe_49k.json"
#: Chunks a worker remembers between batches, and how many are encoded as one text.
MOST_KNOWN, JOINED = 200_000, 256


CLOSING = ".,!?;:"


@functools.cache
def two_byte_letters() -> np.ndarray:
    """By first byte less 0xC3 and second less 0x80: letters of U+00C0 to U+024F that lower case leaves one letter."""
    found = np.zeros((7, 64), bool)
    for code in range(0xC0, 0x250):
        low, (first, second) = chr(code).lower(), chr(code).encode()
        found[first - 0xC3, second - 0x80] = chr(code).isalpha() and len(low) == 1 and low.isalpha()
    return found


def stems_of(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(stems, cut): words without closing punctuation where `cut`, others whole.

    Only where the tokenizer's splits certainly fall before it: no apostrophe in the word, and the
    stem ends in an ASCII letter or digit or in one of two_byte_letters (not U+0130, whose lower case
    ends in a mark that the tokenizer sets together with what follows).
    """
    stems = pc.utf8_rtrim(words, CLOSING)
    size = np.asarray(pc.binary_length(stems)).astype(np.int64)
    short = (size > 0) & (size < np.asarray(pc.binary_length(words)))
    tail = [np.full(len(words), 0, np.uint8), np.full(len(words), 0, np.uint8)]
    _, offsets, data = stems.buffers()
    at = np.frombuffer(offsets, np.int32)[stems.offset : stems.offset + len(stems) + 1].astype(np.int64)[1:]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    for k in (1, 2):
        there = size >= k
        tail[k - 1][there] = raw[at[there] - k]
    last, lead = tail
    plain = (last >= 48) & (last <= 57) | ((last | 32) >= 97) & ((last | 32) <= 122)
    letter = (last >= 0x80) & (last <= 0xBF) & (lead >= 0xC3) & (lead <= 0xC9)
    letter[letter] = two_byte_letters()[lead[letter] - 0xC3, last[letter] - 0x80]
    cut = short & (plain | letter) & ~np.asarray(pc.match_substring(words, "'"))
    return (pc.if_else(pa.array(cut), stems, words) if not cut.all() else stems), cut


def one_word(stem: str) -> bool:
    """Whether a stem certainly is one word to the tokenizer: letters below U+0250 only."""
    return stem.isalpha() and (stem.isascii() or max(stem) < "\u0250")


class Encoder:
    """Token ids of many texts, encoding each distinct stem once; keeps what it knows in flat arrays."""

    def __init__(self, path: str, most_known: int = MOST_KNOWN) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.most_known = Tokenizer.from_file(path), most_known
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.begin, self.size = array("I"), array("q"), array("i")

    def add(self, stems: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        at = len(self.begin)
        self.known.update(zip(stems, range(at, at + len(stems))))
        self.begin.frombytes((np.cumsum(sizes) - sizes + len(self.flat)).astype(np.int64).tobytes())
        self.size.frombytes(sizes.astype(np.int32).tobytes())
        self.flat.frombytes(ids.astype(np.uint32).tobytes())

    def learn(self, stems: list[str]) -> None:
        """Many stems make one text with blanks between. Where each is one word, its ids stop at a word's
        last token; else a token belongs to the stem in which it starts."""
        words = [s for s in stems if one_word(s)]
        groups = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        others = [s for s in stems if not one_word(s)]
        for at in range(0, len(groups), 64):
            some = groups[at : at + 64]
            for group, e in zip(some, self.tokenizer.encode_batch_fast([" ".join(g) for g in some], add_special_tokens=False)):
                ids = np.array(e.ids, np.int64)
                stops = np.flatnonzero(self.ends[ids]) + 1
                if len(stops) == len(group) and stops[-1] == len(ids):
                    self.add(group, np.diff(stops, prepend=0), ids)
                else:
                    others += group
        groups = [others[at : at + JOINED] for at in range(0, len(others), JOINED)]
        for at in range(0, len(groups), 64):
            some = groups[at : at + 64]
            for group, e in zip(some, self.tokenizer.encode_batch([" ".join(g) for g in some], add_special_tokens=False)):
                starts = np.cumsum([0, *(len(c) + 1 for c in group[:-1])])
                owner = np.searchsorted(starts, np.fromiter((o[0] for o in e.offsets), np.int64, len(e)), side="right") - 1
                self.add(group, np.bincount(owner, minlength=len(group)), np.array(e.ids, np.int64))

    def places(self, coded: pa.DictionaryArray) -> np.ndarray:
        """The place of each word's stem in the flat arrays, learning new ones."""
        stems = coded.dictionary.to_pylist()
        if new := [c for c in stems if c not in self.known]:
            self.learn(new)
        return np.fromiter(map(self.known.__getitem__, stems), np.int64, len(stems))[np.asarray(coded.indices)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ends, ids): ids of text k stop before ends[k]; no end ids."""
        offsets, words = split_words(texts)
        if not len(words):
            return np.zeros(len(texts), np.int64), np.zeros(0, np.uint32)
        # The tokenizer folds case itself, but knows special tokens, which have "<|", by their case.
        if not pc.any(pc.match_substring(words, "<|")).as_py():
            words = pc.ascii_lower(words)
        if len(self.known) > self.most_known:
            self.clear()
        stems, cut = stems_of(words)
        # A word is its stem's place and, if it was cut, then its closing punctuation's.
        upto = np.concatenate([[0], np.cumsum(1 + cut)])
        which = np.empty(upto[-1], np.int64)
        which[upto[:-1]] = self.places(stems.dictionary_encode())
        if cut.any():
            whole = words.filter(pa.array(cut))
            which[upto[1:][cut] - 1] = self.places(pc.replace_substring_regex(whole, r"^.*[^.,!?;:]", "").dictionary_encode())
        size = np.frombuffer(self.size, np.int32)[which].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        ids = np.array(self.flat, np.uint32)[np.repeat(np.array(self.begin, np.int64)[which] - total[:-1], size) + np.arange(total[-1])]
        return total[upto[offsets[1:]]], ids


@functools.cache
def encoder(path: str) -> Encoder:
    """A worker process's encoder, kept between tasks; one thread, as a task has one core."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


REMEMBERED["packing"] = encoder.cache_clear


def pieces_of(docs: DataFrame, path: str, size: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids): every piece of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in sliced(batches, "text", keep="packing"):
            ends, ids = known.encode(batch.column("text"))
            row, piece, start, length, crc = [], [], [], [], []
            lo = 0
            for k, hi in enumerate(ends.tolist()):
                own = np.append(ids[lo:hi], np.uint32(end_id)).astype("<u4")
                lo = hi
                for p, at in enumerate(range(0, len(own), size)):
                    part = own[at : at + size]
                    row.append(k)
                    piece.append(p)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def ranked(pieces: DataFrame) -> DataFrame:
    """Pieces range-sorted by length, with their partition and their rank among its pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            length = np.asarray(batch.column("length"))
            if not len(length):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(length)) + 1, [len(length)]])
            rank = np.empty(len(length), np.int64)
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                before = seen.get(v := int(length[lo]), 0)
                rank[lo:hi] = np.arange(before, before + hi - lo)
                seen[v] = before + hi - lo
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(length), part, np.int32)), pa.array(rank)], [*batch.schema.names, "part", "rank"])

    order = [F.col("length").desc(), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")]
    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes) + ", part int, rank long"
    return pieces.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over size classes: (length, first rank, pieces, first sequence, offset) intervals.

    counts: pieces by length. A group of gaps is an interval of sequences with equal gaps.
    """
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> intervals (first sequence, how many)
    sizes: list[int] = []  # the gaps there are, sorted
    made = 0

    def add(gap: int, first: int, n: int) -> None:
        if gap > 0:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(sizes, gap)
            gaps[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(sizes, length)
            # Row by row, a gap that takes a piece is the best one for the next as long as it fits.
            if at < len(sizes):
                gap = sizes[at]
                first, n = gaps[gap].pop()
                each = min(gap // length, left)
                take = min(n, left // each)
                if take < n:
                    gaps[gap].append((first + take, n - take))
                if not gaps[gap]:
                    del gaps[gap]
                    sizes.pop(at)
            else:
                gap, first = size, made
                each = min(size // length, left)
                take = left // each
                made += take
            for k in range(each):
                out.append((length, rank + k * take, take, first, size - gap + k * length))
            rank, left = rank + take * each, left - take * each
            add(gap - each * length, first, take)
    return out


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    pieces = written(pieces_of(slim, path, size, end_id), "pieces")
    table = written(ranked(pieces), "ranked")
    dropped(pieces)
    spark = docs.sparkSession
    # One row for each length and partition: partitions + size rows, as each partition holds a range of lengths.
    rows = table.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).orderBy("length", "part").collect()
    base: dict[tuple[int, int], int] = {}
    counts: dict[int, int] = {}
    for r in rows:
        base[r["length"], r["part"]] = counts.get(r["length"], 0)
        counts[r["length"]] = counts.get(r["length"], 0) + r["n"]
    by_length: dict[int, list[tuple[int, int, int]]] = {}
    for length, rank, _, first, offset in plan(counts, size):
        by_length.setdefault(length, []).append((rank, first, offset))
    looked = {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in by_length.items()}
    shared = spark.sparkContext.broadcast((base, looked))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, looked = shared.value
        for batch in batches:
            length, part, rank = (np.asarray(batch.column(c)) for c in ("length", "part", "rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for v in np.unique(length).tolist():
                at = np.flatnonzero(length == v)
                whole = rank[at] + np.array([base[v, p] for p in part[at].tolist()], np.int64)
                ranks, firsts, offsets = looked[v]
                k = np.searchsorted(ranks, whole, side="right") - 1
                sequence[at], offset[at] = firsts[k] + whole - ranks[k], offsets[k]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return table.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
