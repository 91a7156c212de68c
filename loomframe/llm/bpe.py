"""Byte-level BPE by a fold of ranked merges, and decoding.

A text is cut by the tokenizer's pattern; each match is a word of its own. A word's bytes, as an array, are
folded by Spark's higher-order functions: a step merges the leftmost of the adjacent pairs whose joined bytes
have the lowest rank, until none has a rank. The ranks are a literal: an array of small maps, by a checksum of
the bytes, so that a look-up reads one map of the array; the vocabulary fixes its size.

Words are counted over all texts. Of the distinct words that share one of `slots` slots the most frequent one is
folded, and these go to all tasks as a broadcast that the parameter bounds. Arrow batches of texts then take
their ids from it. A word that isn't among them is folded where it stands by the same rule, and remembered for
a while; so the slots change the cost, never the ids. Nothing but counts is shuffled, and no text leaves its row.
Ids are kept as bytes, four a piece, little-endian. Decoding looks up each id's bytes and concatenates them.

Defined results: a null text is as an empty one, which has no ids; texts of any length are whole; rows are
encoded each, repeated ones alike; an empty table gives an empty table; the columns named in `keep` pass through,
and names of the results may not be among them (any case: ValueError). A word of n bytes takes n steps at most,
each over its remaining pieces.
"""

from __future__ import annotations

import base64
import functools
import json
import re
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from loomframe.llm.common import sliced, tidy

RANKS = "byte_bpe_50k.tiktoken"
#: Slots for frequent words, and maps that the ranks are split over.
SLOTS, RANK_MAPS = 1 << 17, 1 << 14
#: A frequent word's most bytes, which bounds the broadcast.
MOST_BYTES = 64
#: Words that a worker counts before it hands them on, and that it remembers besides the frequent ones.
MOST_COUNTED, MOST_REMEMBERED = 400_000, 200_000
#: No rank.
NONE = 2**31 - 1

# Letters and numbers of Unicode 16, which the tokenizer's pattern knows and Python's tables of
# Unicode 13 to 15 lack.
NEWER_LETTERS = (
    "870-887 889-88E 8B5 8C8-8C9 C5D CDD 170D 171F 1B4C 1C89-1C8A 2C2F 2C5F 9FFD-9FFF A7C0-A7C1 A7CB-A7CD A7D0-A7D1 A7D3 A7D5-A7DC A7F2-A7F4 10570-1057A "
    "1057C-1058A 1058C-10592 10594-10595 10597-105A1 105A3-105B1 105B3-105B9 105BB-105BC 105C0-105F3 10780-10785 10787-107B0 107B2-107BA 10D4A-10D65 "
    "10D6F-10D85 10EC2-10EC4 10F70-10F81 11071-11072 11075 1123F-11240 11380-11389 1138B 1138E 11390-113B5 113B7 113D1 113D3 11740-11746 11AB0-11ABF "
    "11BC0-11BE0 11F02 11F04-11F10 11F12-11F33 12F90-12FF0 1342F 13441-13446 13460-143FA 16100-1611D 16A70-16ABE 16D40-16D6C 18CFF 1AFF0-1AFF3 "
    "1AFF5-1AFFB 1AFFD-1AFFE 1B11F-1B122 1B132 1B155 1DF00-1DF1E 1DF25-1DF2A 1E030-1E06D 1E290-1E2AD 1E4D0-1E4EB 1E5D0-1E5ED 1E5F0 1E7E0-1E7E6 "
    "1E7E8-1E7EB 1E7ED-1E7EE 1E7F0-1E7FE 2A6DE-2A6DF 2B735-2B739 2EBF0-2EE5D 31350-323AF"
)
NEWER_NUMBERS = "10D40-10D49 116D0-116E3 11BF0-11BF9 11F50-11F59 16130-16139 16AC0-16AC9 16D70-16D79 1CCF0-1CCF9 1D2C0-1D2D3 1E4F0-1E4F9 1E5F1-1E5FA"


def _ranges(text: str) -> Iterator[tuple[int, int]]:
    for part in text.split():
        lo, _, hi = part.partition("-")
        yield int(lo, 16), int(hi or lo, 16)


def members(kind: str, newer: str) -> list[tuple[int, int]]:
    """Code points of the categories that start with `kind`, and newer ones, as ranges."""
    there = [c for c in range(0x110000) if unicodedata.category(chr(c))[0] == kind]
    there = sorted({*there, *(c for lo, hi in _ranges(newer) for c in range(lo, hi + 1))})
    ends = [k for k in range(len(there)) if k + 1 == len(there) or there[k + 1] != there[k] + 1]
    return [(there[k + 1], there[e]) for k, e in zip([-1, *ends], ends)]


@functools.cache
def patterns() -> tuple[re.Pattern, re.Pattern]:
    """The tokenizer's pattern for texts within the basic plane, and for all texts: classes with code points beyond
    it are looked through one by one."""

    def made(top: int) -> re.Pattern:
        letter, number = ("".join(f"\\U{lo:08x}-\\U{min(hi, top):08x}" for lo, hi in members(kind, newer) if lo <= top) for kind, newer in (("L", NEWER_LETTERS), ("N", NEWER_NUMBERS)))
        white = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{white}{letter}{number}]+|[{white}]+(?![^{white}])|[{white}]+")

    return made(0xFFFF), made(0x10FFFF)


BEYOND = re.compile("[\U00010000-\U0010ffff]")


def words_of(text: str) -> list[str]:
    basic, whole = patterns()
    return (whole if not text.isascii() and BEYOND.search(text) else basic).findall(text)


def load_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """A rank file: a local one is the driver's, others are read by Spark. The vocabulary bounds its size."""
    if "://" in path:
        lines = [r.value for r in spark.read.text(path).collect()]
    else:
        with open(path) as file:
            lines = file.read().splitlines()
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"no rank for the single bytes {missing[:5]}")
    return ranks


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The ranks as a literal: by crc32 of a token's hex digits modulo RANK_MAPS a map from those digits to the rank."""
    maps: list[dict[str, int]] = [{} for _ in range(RANK_MAPS)]
    for token, rank in ranks.items():
        digits = token.hex().upper()
        maps[zlib.crc32(digits.encode()) % RANK_MAPS][digits] = rank
    return F.from_json(F.lit(json.dumps(maps, separators=(",", ":"))), "array<map<string,int>>")


def folded(word: Column, ranks: Column) -> Column:
    """array<int>: the ids of a word, by merges over the array of its bytes; ranks as rank_map has them."""

    def by(maps: Column) -> Column:
        found = lambda token: F.coalesce(F.get(maps, (F.crc32(token.cast("binary")) % RANK_MAPS).cast("int"))[token], F.lit(NONE))
        rest = F.lit(1 << 30)

        def merged(p: Column, r: Column, at: Column, token: Column) -> Column:
            before = F.when(at > 1, F.array(found(F.concat(F.get(p, at - 2), token)))).otherwise(F.array().cast("array<int>"))
            after = F.array(found(F.concat(token, F.get(p, at + 1))))
            return F.struct(
                F.concat(F.slice(p, 1, at - 1), F.array(token), F.slice(p, at + 2, rest)).alias("p"),
                F.concat(F.slice(r, 1, F.greatest(at - 2, F.lit(0))), before, after, F.slice(r, at + 2, rest)).alias("r"),
            )

        def step(state: Column, _: Column) -> Column:
            """p: pieces; r: by piece the rank of it and the next one."""
            p, r = state["p"], state["r"]
            at = lambda least: F.array_position(r, least).cast("int")
            return let(F.array_min(r), lambda least: F.when(least == NONE, state).otherwise(let(at(least), lambda k: let(F.concat(F.get(p, k - 1), F.get(p, k)), lambda token: merged(p, r, k, token)))))

        def fold(p: Column) -> Column:
            start = F.struct(p.alias("p"), F.zip_with(p, F.slice(p, 2, rest), lambda a, b: found(F.concat(a, b))).alias("r"))
            return F.aggregate(F.slice(p, 2, rest), start, step, lambda state: F.transform(state["p"], found))

        # a word that is a token of its own is looked for first
        whole = lambda digits: let(found(digits), lambda one: F.when(one != NONE, F.array(one)).otherwise(let(F.regexp_extract_all(digits, F.lit(".."), F.lit(0)), fold)))
        return let(F.hex(word), whole)

    return let(ranks, by)


class Words(dict):
    """Word -> ids as bytes. Those it lacks are folded when they are asked for, and remembered until forget()."""

    def __init__(self, known: dict[str, bytes], ranks: dict[bytes, int]) -> None:
        super().__init__(known)
        self.ranks, self.known, self.most = ranks, known, len(known) + MOST_REMEMBERED

    def forget(self) -> None:
        if len(self) > self.most:
            self.clear()
            self.update(self.known)

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = array("I", self.merged(word.encode())).tobytes()
        return ids

    def merged(self, whole: bytes) -> list[int]:
        rank = self.ranks.get
        if (one := rank(whole)) is not None:
            return [one]
        pieces = [whole[k : k + 1] for k in range(len(whole))]
        after = [rank(a + b, NONE) for a, b in zip(pieces, pieces[1:])] + [NONE]
        while (least := min(after)) != NONE:
            k = after.index(least)
            pieces[k : k + 2] = [token := pieces[k] + pieces[k + 1]]
            del after[k]
            after[k] = rank(token + pieces[k + 1], NONE) if k + 1 < len(pieces) else NONE
            if k:
                after[k - 1] = rank(pieces[k - 1] + token, NONE)
        return [self.ranks[p] for p in pieces]


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) over all texts, counted within a task before they are shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()

        def told() -> Iterator[pa.RecordBatch]:
            words = list(n)
            for at in range(0, len(words), 50_000):
                some = words[at : at + 50_000]
                yield pa.record_batch({"word": pa.array(some, pa.string()), "n": pa.array([n[w] for w in some], pa.int64())})
            n.clear()

        for batch in sliced(batches, text):
            for t in batch.column(text):
                n.update(words_of(t.as_py() or ""))
            if len(n) > MOST_COUNTED:
                yield from told()
        yield from told()

    return docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(docs: DataFrame, text: str, ranks: dict[bytes, int], slots: int = SLOTS) -> DataFrame:
    """(word, ids) of each slot's most frequent word, folded."""
    words = word_counts(docs, text).where(F.octet_length("word") <= MOST_BYTES)
    best = words.groupBy(F.pmod(F.hash("word"), F.lit(slots)).alias("slot")).agg(F.max(F.struct("n", "word")).alias("most"))
    return best.select("most.word").select("word", folded(F.col("word"), rank_map(ranks)).alias("ids"))


def encode(docs: DataFrame, ranks: dict[bytes, int], text: str = "text", keep: Sequence[str] = ("doc_id",), slots: int = SLOTS) -> DataFrame:
    """The columns of `keep` with `n_tokens` and `ids`, the ids of the text as little-endian unsigned 32-bit integers."""
    unlike(keep, "n_tokens", "ids")
    spark = docs.sparkSession
    with tidy(spark):
        known = {r.word: array("I", r.ids).tobytes() for r in frequent(docs, text, ranks, slots).collect()}  # slots rows at most
    shared = spark.sparkContext.broadcast((known, ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(*shared.value)
        for batch in sliced(batches, "_text"):
            ids = [b"".join(map(words.__getitem__, words_of(t.as_py() or ""))) for t in batch.column("_text")]
            words.forget()
            made = pa.array(ids, pa.binary())
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], n, made], names=[*keep, "n_tokens", "ids"])

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    schema = StructType([*[docs.schema[c] for c in keep], StructField("n_tokens", LongType()), StructField("ids", BinaryType())])
    return rows.mapInArrow(run, schema)


def decode(rows: DataFrame, ranks: dict[bytes, int], ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """rows with the bytes that the ids stand for; null ids: null. An id without a rank raises."""
    unlike(rows.columns, decoded)
    shared = rows.sparkSession.sparkContext.broadcast({rank: token for token, rank in ranks.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = shared.value.__getitem__
        for batch in sliced(batches, ids):
            texts = [None if x is None else b"".join(map(piece, array("I", x))) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=[*batch.schema.names, decoded])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(decoded, BinaryType())]))


def unlike(columns: Sequence[str], *names: str) -> None:
    """No column may have one of the names."""
    if clash := {n.lower() for n in names} & {c.lower() for c in columns}:
        raise ValueError(f"columns with names of the result: {sorted(clash)}")
