"""Recursion over tables by semi-naive iteration: fixpoints, closures, distances, hierarchies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.operators.ranges import same
from loomframe.sources.stages import stage, unstage


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str] | None = None) -> DataFrame:
    """The seed's rows and all that `step` makes of them, of their results, and so on.

    Each round steps from the rows that the last one added, and adds those whose `keys` (all columns, if not given) are
    not known; of new rows with equal keys the smallest stays. So cycles end, and with keys that leave a distance out,
    a row keeps its first one. Rounds are as many as the longest shortest way; each writes its new rows only. Known rows
    are looked up from the candidates' side: those among them that candidates meet are joined out first, which Spark
    does without a shuffle of all known rows when the candidates are few, and the candidates lose these.
    """
    keys = keys or seed.columns
    rest = [c for c in seed.columns if c not in keys]

    def one_each(rows: DataFrame) -> DataFrame:
        if not rest:
            return rows.select(*keys).distinct()
        return rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_rest")).select(*keys, *[F.col(f"_rest.`{c}`").alias(c) for c in rest]).select(*seed.columns)

    added = stage(one_each(seed), "round")
    known = [added]
    while True:
        found = stage(one_each(step(added).select(*seed.columns)), "candidates")
        old = known[0]
        for more in known[1:]:
            old = old.unionByName(more)
        met = old.select(*keys).alias("_l").join(found.select(*keys).alias("_r"), same("_l", "_r", keys), "left_semi")
        new = stage(found.alias("_l").join(met.alias("_r"), same("_l", "_r", keys), "left_anti"), "round")
        unstage(found)
        if new.isEmpty():
            unstage(new)
            return old
        added = new
        known.append(new)
        if len(known) > 16:
            # files of many small rounds become one table
            merged = stage(old.unionByName(new), "known")
            unstage(*known[:-1])
            known = [merged]


def closure(edges: DataFrame, source: str, target: str) -> DataFrame:
    """(source, target): all pairs with a way of one edge or more; edges with a null end lead nowhere.

    A round extends the pairs that were new by the edges from their targets.
    """
    pairs = edges.select(F.col(f"`{source}`").alias("source"), F.col(f"`{target}`").alias("target")).where("source is not null and target is not null").distinct()
    ways = stage(pairs, "edges")

    def longer(new: DataFrame) -> DataFrame:
        return new.alias("_l").join(ways.alias("_r"), F.col("_l.target") == F.col("_r.source")).select("_l.source", "_r.target")

    return fixpoint(ways, longer).select(F.col("source").alias(source), F.col("target").alias(target))


def distances(edges: DataFrame, source: str, target: str, roots: DataFrame) -> DataFrame:
    """(node, level): the least number of edges from any root (one column), 0 for the roots; nodes out of reach have no row."""
    ways = edges.select(F.col(f"`{source}`").alias("_from"), F.col(f"`{target}`").alias("_to")).where("_from is not null and _to is not null").distinct()
    ways = stage(ways, "edges")
    first = roots.select(F.col(roots.columns[0]).alias("node"), F.lit(0).alias("level")).where("node is not null")

    def further(new: DataFrame) -> DataFrame:
        return new.join(ways, F.col("node") == F.col("_from")).select(F.col("_to").alias("node"), (F.col("level") + 1).alias("level"))

    return fixpoint(first, further, ["node"])


def hierarchy(rows: DataFrame, node: str, parent: str, measure: str) -> DataFrame:
    """(node, root, level, total): each node's root, depth and the sum of `measure` on the way from the root to it.

    A node without a parent is a root; nodes on a cycle, or below a parent that isn't there, have no row. A node has
    one parent; of more, each gives a row if their ways differ.
    """
    own = stage(rows.select(F.col(f"`{node}`").alias("node"), F.col(f"`{parent}`").alias("_parent"), F.col(f"`{measure}`").alias("_measure")), "nodes")
    roots = own.where("_parent is null and node is not null").select("node", F.col("node").alias("root"), F.lit(0).alias("level"), F.col("_measure").alias("total"))

    def below(new: DataFrame) -> DataFrame:
        return new.withColumnRenamed("node", "_above").join(own, F.col("_parent") == F.col("_above")).select("node", "root", (F.col("level") + 1).alias("level"), (F.col("total") + F.col("_measure")).alias("total"))

    return fixpoint(roots, below)
