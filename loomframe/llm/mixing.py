"""Mixing sources to target weights, by blocks and pseudorandom permutations.

A source's documents, in a fixed pseudorandom order, form one stream of words, cut into blocks of
`block` words. Each source fills a fixed number of slots of the output, which is dealt over shards of
`shard_slots` slots by one pseudorandom permutation of all slots: a shard's counts by source are thus a
multinomial draw conditioned on every source's total, the same at every size, and are never gathered.
The j-th slot of a source takes the block at j modulo n of that source's permutation of its n blocks;
each pass over the source has a permutation of its own (Feistel networks with cycle walking). Slots join
blocks by index.

Targets: sources by code point, null last, weigh 5, 2, 1, 5, ...; they share all words by weight; a
target stops at `most` times its source's size and the excess is shared again. Every block is used
k or k + 1 times with k + 1 <= most, so no document exceeds `most` times its size. The sources are a
table like any other: nothing of their number reaches the driver or is broadcast without a size check.

Defined results: null and empty texts have size 0 and are never taken; a null source is a source of
its own; rows that share a doc_id are told apart by their text, and equal rows are one document that
counts once for each row; texts of any length are whole; an empty table gives an empty table. `texts` keeps all other columns, whatever
their names, of the row whose other columns have the least hash if rows differ in those alone; n_chars, if
there, keeps its type.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm.common import SPACE, dropped, sliced, written

WEIGHTS, MOST, BLOCK, SHARD_SLOTS, SEED = (5, 2, 1), 3, 128, 4096, 7
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Slots that one row of a range stands for.
RANGE = 1 << 16


def word_count(text: Column) -> Column:
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.translate(t, " ", "")) + 1).cast("long")


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(size) at the given places."""
    half = max(1, (max(1, size - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for r in range(4):
            x = right * np.uint64(0x9E3779B97F4A7C15) + np.uint64((key * 0xD6E8FEB86659FD93 + r * 0xA0761D6478BD642F) % (1 << 64))
            x ^= x >> np.uint64(29)
            x *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((x >> np.uint64(32)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


def upto(table: DataFrame, value: Column, name: str) -> DataFrame:
    """table, whose `part`s follow each other and are sorted by `at`, with the sum of value over all rows before."""
    own = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each partition of the table.
    parts = table.groupBy("part").agg(F.sum(value).alias("_sum"))
    parts = parts.select(F.col("part"), (F.sum("_sum").over(Window.orderBy("part")) - F.col("_sum")).alias("_base"))
    rows = table.withColumn(name, F.coalesce(F.sum(value).over(own), F.lit(0)))
    return rows.join(parts, "part").withColumn(name, F.col(name) + F.col("_base")).drop("_base")


def figures_of(sized: DataFrame, weights: tuple[int, ...], most: int, block: int) -> DataFrame:
    """(part, at, k, source, source_size, n, target, blocks, total, base) of each source: its number, words, rows,
    target, blocks, slots and the slots of the sources before it. A written table."""
    order = [F.col("source").isNull(), F.col("source")]
    found = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    found = found.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    found = written(found.withColumn("part", F.shiftright("at", 33)), "sources")
    kinds = F.array(*[F.lit(w).cast("long") for w in weights])
    found, old = written(upto(found, F.lit(1).cast("long"), "k").withColumn("weight", F.get(kinds, (F.col("k") % len(weights)).cast("int"))), "numbered"), found
    dropped(old)
    whole = found.agg(F.sum("source_size"), F.sum("weight")).first()
    all_words, all_weights = whole[0] or 0, whole[1] or 0
    unit, full = all_words / max(1, all_weights), 0
    while True:
        # The sources that stop at `most` take less than their share, which raises the others'.
        stops = F.lit(unit) * F.col("weight") > F.lit(most) * F.col("source_size")
        row = found.where(stops).agg(F.count(F.lit(1)), F.sum(F.lit(most) * F.col("source_size")), F.sum("weight")).first()
        if row[0] == full:
            break
        full, unit = row[0], (all_words - (row[1] or 0)) / (all_weights - (row[2] or 0))
    target = F.least(F.lit(unit) * F.col("weight"), (F.lit(most) * F.col("source_size")).cast("double"))
    blocks = F.ceil(F.col("source_size") / block)
    total = F.when(F.col("source_size") > 0, F.least(F.round(target * blocks / F.col("source_size")).cast("long"), most * blocks)).otherwise(F.lit(0).cast("long"))
    rows = found.select("part", "at", "k", "source", "source_size", "n", target.alias("target"), blocks.alias("blocks"), total.alias("total"))
    out = written(upto(rows, F.col("total"), "base"), "figures")
    dropped(found)
    return out


class Mix:
    """The source figures and the lazily joined slots of a mix."""

    def __init__(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> None:
        slim = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), F.xxhash64(F.col(f"`{text}`")).alias("mark"), word_count(F.col(f"`{text}`")).alias("size"))
        self.sized = written(slim, "sized")
        self.figures = figures_of(self.sized, weights, most, block)
        self.block = block
        figures = self.figures.select("k", F.col("source").alias("_source"), "source_size", "target", "n")
        self.rows = self.sized.join(figures, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        self.pieces = self._pieces()
        #: (shard, slot, k, turn, block): a row for each slot of the output
        self.slots = self._slots(shard_slots, seed)
        #: (shard, slot, k, turn, block, doc_id, mark, row, first, n): what each slot of the output holds
        # Neither side has a size bound, and that of the slots can't be estimated: never broadcast.
        self.taken = self.slots.join(self.pieces.hint("merge"), ["k", "block"])

    def _pieces(self) -> DataFrame:
        """(k, block, doc_id, mark, row, first, n): the words of each block, by document; row is the place of a document in its stream."""
        # Running counts go over the square root of n buckets of as many documents: neither the buckets nor a bucket's rows pile up in one task.
        rows = self.rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "mark"), F.greatest(F.lit(1), F.floor(F.sqrt("n")))))
        order = [F.xxhash64("doc_id", "mark", F.lit(1)), F.col("doc_id"), F.col("mark")]
        base = rows.groupBy("k", "bucket").agg(F.sum("size").alias("s"))
        base = base.withColumn("base", F.sum("s").over(Window.partitionBy("k").orderBy("bucket")) - F.col("s")).drop("s")
        rows = rows.where("size > 0").withColumn("end", F.sum("size").over(Window.partitionBy("k", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
        rows = rows.join(base, ["k", "bucket"]).withColumn("begin", F.col("base") + F.col("end") - F.col("size"))
        size = F.lit(self.block)
        rows = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("begin") / size), F.floor((F.col("begin") + F.col("size") - 1) / size))))
        first = F.greatest(F.col("block") * size - F.col("begin"), F.lit(0))
        return rows.select("k", "block", "doc_id", "mark", F.col("begin").alias("row"), first.alias("first"), (F.least((F.col("block") + 1) * size - F.col("begin"), F.col("size")) - first).alias("n"))

    def _slots(self, shard_slots: int, seed: int) -> DataFrame:
        spark = self.figures.sparkSession
        slots = self.figures.agg(F.sum("total")).first()[0] or 0
        last = F.ceil(F.col("total") / RANGE) - 1
        ranges = self.figures.where("total > 0").select("k", "total", "base", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("r"))
        # A named number of partitions, as few small rows stand for many slots.
        parts = max(1, min(-(-slots // RANGE), spark.sparkContext.defaultParallelism * 4 + slots // (RANGE * 16)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k, total, base, blocks, r in zip(*[batch.column(c).to_pylist() for c in ("k", "total", "base", "blocks", "r")]):
                    j = np.arange(r * RANGE, min((r + 1) * RANGE, total))
                    turn, place = j // blocks, np.empty(len(j), np.int64)
                    for t in range(int(turn[0]), int(turn[-1]) + 1):
                        at = turn == t
                        place[at] = permuted(j[at] % blocks, blocks, seed * 1_000_003 + k * 101 + t)
                    g = permuted(base + j, slots, seed)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g // shard_slots, g % shard_slots, np.full(len(j), k), turn.astype(np.int32), place)], ["shard", "slot", "k", "turn", "block"])

        return ranges.repartition(parts, "k", "r").mapInArrow(run, "shard long, slot long, k long, turn int, block long")

    def by_document(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken) of every row."""
        taken = self.taken.groupBy("doc_id", "mark", "k").agg(F.sum("n").alias("taken"))
        same = self.rows.groupBy("doc_id", "mark", "k").agg(F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
        t = taken.select(F.col("doc_id").alias("_d"), F.col("mark").alias("_m"), F.col("k").alias("_k"), "taken")
        joined = same.join(t, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("mark").eqNullSafe(F.col("_m")) & (F.col("k") == F.col("_k")), "left")
        # equal rows share what their text was taken for
        joined = joined.withColumn("c", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        n = F.coalesce("taken", F.lit(0))
        share = F.floor(n / F.col("copies")) + F.when(F.col("c") <= n % F.col("copies"), 1).otherwise(0)
        return joined.select("doc_id", "size", "source_size", "target", share.cast("long").alias("taken"))

    def texts(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
        """The rows of docs (the same as were given) as the mix takes them: for each row and pass one
        row for each run of adjoining blocks, with `text` cut to the run's words and `n_chars` to it."""
        # Runs: within a row and pass, blocks whose numbers follow each other.
        order = Window.partitionBy("doc_id", "mark", "k", "turn", "row").orderBy("first")
        parts = self.taken.withColumn("run", F.col("first") - F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        runs = parts.groupBy("doc_id", "mark", "k", "turn", "row", "run").agg(F.min("first").alias("first"), F.sum("n").alias("n"))
        lists = runs.groupBy("doc_id", "mark", "k").agg(F.collect_list(F.struct("turn", "row", "first", "n")).alias("runs"))
        lists = written(lists.join(self.figures.select("k", "source"), "k").select("doc_id", "mark", "source", "runs"), "runs")
        names = docs.columns
        keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{doc_id}`").alias("_d"), F.xxhash64(F.col(f"`{text}`")).alias("_m"), F.col(f"`{source}`").cast("string").alias("_s"), F.xxhash64(*[F.col(f"`{c}`") for c in names if c != text] or [F.lit(0)]).alias("_h"))
        # One row carries all runs of rows that are equal.
        one = keyed.groupBy("_d", "_m", "_s").agg(F.min_by("row", "_h").alias("row"))
        same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("mark").eqNullSafe(F.col("_m")) & F.col("source").eqNullSafe(F.col("_s"))
        rows = one.join(lists, same).select("row", "runs", F.col(f"row.`{text}`").alias("text"))
        at_text, at_chars = names.index(text), names.index("n_chars") if "n_chars" in names else -1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, "text"):
                own, out = [], []
                for i, (t, parts) in enumerate(zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist())):
                    ends = [m.span() for m in WORD.finditer(t)]
                    for p in sorted(parts, key=lambda p: (p["turn"], p["row"], p["first"])):
                        lo, hi = p["first"], p["first"] + p["n"]
                        own.append(i)
                        out.append(t[(ends[lo][0] if lo else 0) : (ends[hi - 1][1] if hi < len(ends) else len(t))])
                columns = [c if k in (at_text, at_chars) else c.take(pa.array(own, pa.int64())) for k, c in enumerate(batch.column("row").flatten())]
                columns[at_text] = pa.array(out, pa.string())
                if at_chars >= 0:
                    columns[at_chars] = pa.array([len(t) for t in out], pa.int64()).cast(columns[at_chars].type)
                yield pa.RecordBatch.from_arrays(columns, names)

        return rows.mapInArrow(run, docs.schema)
