"""Embedding near-duplicates by random-hyperplane sign hashing in several tables, verified exactly.

Equal vectors of a label become one class with a weight, so copies are never paired. The signs and
tables of a label follow from its number of rows n: log2(n) signs, so that unlike vectors are few in a
bucket at every size, and as many tables as keep the chance to miss a pair at the threshold itself
below `miss`; closer pairs are missed less often. Classes that share a label and a table's signs form
a bucket; buckets with equal members are one. Large buckets are cut into chunks and each pair of
chunks is a task. A pair is counted in the first bucket that holds it, which both classes' signs
show; its cosine is computed in double precision from whole vectors. A task emits a count for each
member and the links of a spanning forest, never its pairs. Links that are found are exact.

Defined results: a null label, a null, empty or zero vector or one with null or non-finite
components links with nothing: n_links 0, component_id its own id, kept; vectors of other length
than the label's others are compared with those of their length only; rows that share a vec_id
count as rows, and are one vertex: they have one component, through the links of each; rows with a null
vec_id count as links of others, but connect nothing and have a null component and a null kept; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import dropped, written
from loomframe.llm.components import components, owners, with_least

THRESHOLD, MISS, SEED = 0.98, 1e-4, 20240229
#: Rows of a bucket in a chunk: as many whole vectors as a task holds twice.
CHUNK = 1 << 13
#: Signs of a code at least and at most, whatever a label's number of rows.
LEAST_BITS, MOST_BITS = 8, 60


def tables_for(bits: int, threshold: float, miss: float) -> int:
    """How many tables a pair at the threshold misses all of with a chance of `miss` at most."""
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


@functools.lru_cache(64)
def planes(size: int, bits: int, tables: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size, bits]).standard_normal((size, bits * tables))


def signs(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """A row of `tables` codes for each vector."""
    positive = (vectors @ planes(vectors.shape[1], bits, tables, seed) > 0).reshape(len(vectors), tables, bits)
    return positive @ (1 << np.arange(bits, dtype=np.int64))


def usable(v: Column, label: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def coded(classes: DataFrame, threshold: float, miss: float, seed: int) -> DataFrame:
    """classes with codes, one for each table of their label."""
    names = [n for n in classes.columns if n != "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, bits = batch.column("v"), np.asarray(batch.column("bits"))
            size = np.asarray(lists.value_lengths())
            flat, ends = np.asarray(lists.flatten()), np.concatenate([[0], np.cumsum(size)])
            each: list[np.ndarray] = [np.zeros(0, np.int64)] * len(size)
            for n, b in set(zip(size.tolist(), bits.tolist())):
                at = np.flatnonzero((size == n) & (bits == b))
                rows = flat[ends[at][:, None] + np.arange(n)]
                rows = rows / np.abs(rows).max(axis=1, keepdims=True)
                for k, codes in zip(at.tolist(), signs(rows, b, tables_for(b, threshold, miss), seed)):
                    each[k] = codes
            upto = np.concatenate([[0], np.cumsum([len(e) for e in each])])
            codes = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(np.concatenate(each)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], codes], [*names, "codes"])

    kinds = dict(classes.dtypes)
    return classes.mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names) + ", codes array<long>")


KEYS = ["label", "t", "code", "dim", "lo", "hi"]


#: Rows and bytes of a block of whole groups, the size from which a group's cosines are matrix products, and their cells.
BLOCK, BLOCK_BYTES, LARGE, CELLS = 1 << 13, 8 << 20, 48, 1 << 21


def pairs_within(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of the groups, by groups of one size."""
    for n in np.unique(sizes[sizes > 1]).tolist():
        a, b = np.triu_indices(n, 1)
        at = starts[sizes == n]
        step = max(1, (1 << 16) // len(a))
        for k in range(0, len(at), step):
            yield (at[k : k + step, None] + a).ravel(), (at[k : k + step, None] + b).ravel()


def similar(v: np.ndarray, starts: np.ndarray, sizes: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a group with that cosine; many small groups are compared at once, a large one by strips."""
    small = sizes < LARGE
    for i, j in pairs_within(starts[small], sizes[small]):
        ok = np.einsum("nd,nd->n", v[i], v[j]) >= threshold
        yield i[ok], j[ok]
    for at, n in zip(starts[~small].tolist(), sizes[~small].tolist()):
        step = max(1, CELLS // n)
        for k in range(0, n, step):
            # from the strip's first row on: each pair once
            i, j = np.nonzero(v[at + k : at + min(k + step, n)] @ v[at + k : at + n].T >= threshold)
            yield i[i < j] + at + k, j[i < j] + at + k


class Joined:
    """A spanning forest over rows, from pairs that come in blocks."""

    def __init__(self, n: int) -> None:
        self.of = np.arange(n)

    def hooked(self, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Those of the pairs that join what wasn't joined. In a turn each set hooks on to the least one that it meets."""
        while True:
            apart = self.of[i] != self.of[j]
            i, j = i[apart], j[apart]
            if not len(i):
                return
            low, high = np.minimum(self.of[i], self.of[j]), np.maximum(self.of[i], self.of[j])
            parent = np.arange(len(self.of))
            np.minimum.at(parent, high, low)
            chosen = np.full(len(parent), -1)
            least = np.flatnonzero(parent[high] == low)
            chosen[high[least]] = least
            chosen = chosen[chosen >= 0]
            yield i[chosen], j[chosen]
            while (parent[parent] != parent).any():
                parent = parent[parent]
            self.of = parent[self.of]


def compared(block: pa.Table, starts: np.ndarray, threshold: float) -> pa.RecordBatch:
    """(kind, a, b) of the groups that start there: 0 a class and the weight of its partners here, 1 a link of the forest."""
    node, weight, side, named, t, lo, hi, dim = (np.asarray(block[c]) for c in ("node", "weight", "side", "named", "t", "lo", "hi", "dim"))
    sizes = np.diff(np.append(starts, len(node)))
    lists = block["codes"].chunk(0)
    length = np.asarray(lists.value_lengths())
    codes = np.zeros((len(node), int(length.max())), np.int64)
    codes[np.arange(codes.shape[1]) < length[:, None]] = np.asarray(lists.flatten())
    flat, ends = np.asarray(block["v"].chunk(0).flatten()), np.cumsum(dim)
    before = np.arange(codes.shape[1])
    # a class may stand in several groups
    names, of = np.unique(node, return_inverse=True)
    forest, partners = Joined(len(names)), np.zeros(len(node))
    links = [(np.zeros(0, np.int64),) * 2]
    for d in np.unique(dim).tolist():
        rows = np.flatnonzero(dim == d)
        v = flat[(ends[rows] - d)[:, None] + np.arange(d)]
        v = v / np.abs(v).max(axis=1, keepdims=True)
        v = v / np.sqrt((v * v).sum(axis=1, keepdims=True))
        own = dim[starts] == d
        for i, j in similar(v, np.searchsorted(rows, starts[own]), sizes[own], threshold):
            for k in range(0, len(i), 1 << 16):
                a, b = rows[i[k : k + (1 << 16)]], rows[j[k : k + (1 << 16)]]
                # One of each chunk, where the group is a pair of chunks; and the first bucket that holds a pair counts it.
                keep = (lo[a] == hi[a]) | (side[a] != side[b])
                keep[keep] = ~((codes[a[keep]] == codes[b[keep]]) & (before < t[a[keep]][:, None])).any(axis=1)
                a, b = a[keep], b[keep]
                partners += np.bincount(a, weight[b], len(node)) + np.bincount(b, weight[a], len(node))
                both = named[a] & named[b]
                links += [(names[x], names[y]) for x, y in forest.hooked(of[a[both]], of[b[both]])]
    some = np.flatnonzero(partners)
    one, two = (np.concatenate([link[k] for link in links]) for k in (0, 1))
    kind = np.concatenate([np.zeros(len(some), np.int32), np.ones(len(one), np.int32)])
    a = np.concatenate([node[some], one])
    b = np.concatenate([partners[some].astype(np.int64), two])
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (kind, a, b)], ["kind", "a", "b"])


def linked(threshold: float):
    """A mapInArrow function over partitions sorted by KEYS: blocks of whole groups, compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            n = table.num_rows
            change = np.zeros(n, bool)
            change[:1] = True
            for c in KEYS:
                column = table[c].chunk(0)
                change[1:] |= np.asarray(pc.not_equal(column.slice(1), column.slice(0, n - 1)))
            starts = np.flatnonzero(change)
            held.clear()
            if not last:
                # The last group may go on.
                held.extend(table.slice(starts[-1]).to_batches())
                table, starts = table.slice(0, starts[-1]).combine_chunks(), starts[:-1]
            if len(starts):
                yield compared(table, starts, threshold)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(b.num_rows for b in held) >= BLOCK or sum(b.nbytes for b in held) >= BLOCK_BYTES:
                    yield from blocks(False)
        if held:
            yield from blocks(True)

    return run


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, miss: float = MISS, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept): a row per row of vectors."""
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast("array<double>").alias("v"), F.col(f"`{label}`").cast("string").alias("label"))
    # -0.0 and 0.0 are one component; two hashes tell classes apart
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    rows = rows.withColumns({"h1": F.xxhash64("label", "v"), "h2": F.xxhash64("v", "label", F.lit(1))})
    width = F.least(F.lit(MOST_BITS), F.greatest(F.lit(LEAST_BITS), F.ceil(F.log2(F.col("n"))))).cast("int")
    labels = rows.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n")).select("label", width.alias("bits"))
    good = rows.where(usable(F.col("v"), F.col("label")))
    classes = good.groupBy("label", "v").agg(F.first("h1").alias("h1"), F.first("h2").alias("h2"), F.min("vec_id").alias("lead"), F.count(F.lit(1)).alias("weight"))
    # The numbers are fixed as they are written.
    table = coded(classes.join(labels, "label"), threshold, miss, seed).withColumn("node", F.monotonically_increasing_id())
    table = written(table.withColumn("named", F.col("lead").isNotNull()), "codes")
    places = table.select("node", "label", F.size("v").alias("dim"), F.posexplode("codes").alias("t", "code"))
    tags = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(name) for k, name in ((1, "x"), (2, "y"))]
    buckets = places.groupBy("label", "t", "code", "dim").agg(F.count(F.lit(1)).alias("size"), *tags).where("size > 1")
    # Of buckets with equal members, the one of the first table.
    buckets = buckets.groupBy("label", "dim", "size", "x", "y").agg(F.min(F.struct("t", "code")).alias("b"))
    parts = F.ceil(F.col("size") / F.lit(CHUNK)).cast("int")
    # The code is disguised for the join, so that a hot bucket's rows can be split.
    buckets = buckets.select("label", "b.t", F.bitwise_not("b.code").alias("mask"), "dim", "size")
    members = places.withColumn("mask", F.bitwise_not("code")).join(buckets, ["label", "t", "mask", "dim"])
    members = members.withColumn("side", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    members = members.select("label", "t", "code", "dim", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "node")
    filled = members.join(table.select("node", "named", "weight", "v", "codes"), "node")
    found = filled.repartition(*KEYS).sortWithinPartitions(*KEYS).mapInArrow(linked(threshold), "kind int, a long, b long")
    found = written(found, "found")
    counts = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    links = found.where("kind = 1").select("a", "b")
    # A vec_id's unlike vectors are one vertex: its classes are linked.
    ids = rows.where("vec_id is not null").groupBy("vec_id").agg(F.min("h1").alias("x"), F.max("h1").alias("y"), F.min("h2").alias("z"), F.max("h2").alias("w")).where("x < y or z < w")
    ids = written(ids.select("vec_id"), "shared-ids")
    shared = rows.select("vec_id", "h1", "h2").join(ids, "vec_id", "left_semi")
    stars = components(links.union(owners(shared.join(table.select("h1", "h2", "node"), ["h1", "h2"]).select("vec_id", "node"), "vec_id")))
    ends = with_least(table.select("node", "h1", "h2", "lead", "weight"), stars, "lead").join(counts, "node", "left")
    ends = written(ends.select("h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "first"), "ends")
    also = written(shared.join(ends, ["h1", "h2"]).groupBy("vec_id").agg(F.min("first").alias("of_id")), "of-ids")
    dropped(found, table, stars, ids)
    out = rows.select("vec_id", "h1", "h2").join(ends, ["h1", "h2"], "left").join(also, "vec_id", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("first", "of_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
