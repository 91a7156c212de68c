"""Connected components of an edge table, by alternating large-star and small-star rounds.

Edges are first contracted inside each partition (union-find over runs of a partition's edges of a
bounded size), then the two star steps run until all links are stars. No step gathers a component in one place:
minima are pre-aggregated, and the joins that send them back have plain exchanges on both sides, so
adaptive execution can split a hot centre.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import dropped, written

class Forest:
    """Union-find; a set's root is its smallest member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (above := self.up.get(root, root)) != root:
            root = above
        while x != root:
            self.up[x], x = root, self.up.get(x, x)
        return root

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


#: Nodes that a partition's union-find holds at a time.
MOST_HELD = 1 << 20


def contracted(edges: DataFrame, most: int = MOST_HELD) -> DataFrame:
    """Each partition's edges as stars (a, b), a > b: the same components, a row per non-root at most; begun anew when `most` nodes are held."""

    def stars(forest: Forest) -> Iterator[pa.RecordBatch]:
        nodes = np.fromiter(forest.up, np.int64, len(forest.up))
        roots = np.fromiter((forest.find(x) for x in nodes.tolist()), np.int64, len(nodes))
        for at in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + (1 << 16)]), pa.array(roots[at : at + (1 << 16)])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if a != b:
                    forest.join(a, b)
            if len(forest.up) > most:
                yield from stars(forest)
                forest = Forest()
        yield from stars(forest)

    return edges.select(F.col(edges.columns[0]).cast("long").alias("a"), F.col(edges.columns[1]).cast("long").alias("b")).mapInArrow(run, "a long, b long")


def told(rows: DataFrame, key: str, minima: DataFrame) -> DataFrame:
    """rows with m, the minimum of their key. The key is disguised so that neither side's partitioning
    is reused: with an exchange on each side a hot key can be split."""
    right = minima.select(F.col(key).bitwiseXOR(F.lit(1)).alias("_k"), "m")
    return rows.withColumn("_k", F.col(key).bitwiseXOR(F.lit(1))).join(right, "_k").drop("_k")


def settled(stars: DataFrame) -> bool:
    """Whether each node has one centre and no centre has one of its own."""
    ends = stars.select(F.col("a").alias("v"), F.col("b").alias("c"), F.lit(0).alias("centre")).union(stars.select("b", F.lit(None).cast("long"), F.lit(1)))
    odd = ends.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("centre").alias("centre")).where("lo < hi or (centre = 1 and lo is not null)")
    return odd.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node that isn't its component's smallest, that smallest node.

    Takes the first two columns as undirected links of long ids; loops and repeated links are
    harmless; an empty table gives an empty one. The result is a written table. It goes on until all
    is settled: the two steps are known to converge.
    """
    table = written(contracted(edges).distinct(), "links")
    while not settled(table):
        both = table.select(F.col("a").alias("b"), F.col("b").alias("w")).union(table.select("b", F.col("a").alias("w")))
        low = both.groupBy("b").agg(F.min("w").alias("w")).select("b", F.least("b", "w").alias("m"))
        large = written(told(table, "b", low).select("a", F.col("m").alias("b")), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = told(large, "a", low).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = written(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        dropped(large, table)
        table = after
    return table.select(F.col("a").alias("node"), F.col("b").alias("component"))


def with_least(classes: DataFrame, found: DataFrame, lead: str) -> DataFrame:
    """classes, which have a `node`, with `first`: the least `lead` of the classes of their component; found is what components gave."""
    members = found.union(found.select(F.col("component").alias("node"), "component").distinct())
    least = classes.select("node", lead).join(members, "node").groupBy("component").agg(F.min(lead).alias("first"))
    # As in told, a disguised key leaves the join of a hot component splittable.
    least = least.select(F.bitwise_not("component").alias("_c"), "first")
    rows = classes.join(members, "node", "left").withColumn("_c", F.bitwise_not("component")).join(least, "_c", "left")
    return rows.withColumn("first", F.coalesce("first", lead)).drop("_c", "component")


def owners(rows: DataFrame, key: str) -> DataFrame:
    """Links (a, b) between the nodes that rows of one key have: from each to the least."""
    least = rows.groupBy(key).agg(F.min("node").alias("b"))
    return rows.join(least, key).where("node != b").select(F.col("node").alias("a"), "b").distinct()
