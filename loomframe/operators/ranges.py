"""Rows in range partitions of a key and an order: what order-dependent operators share, so that a hot key is split."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.sources.stages import stage

#: Columns that `ranged` adds: the partition and the row's number in it.
PART, ROW = "_part", "_row"


def ranged(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df range-partitioned and sorted by keys and order, as a written table with PART and ROW.

    Written, as the bounds are sampled: what reads it twice must see the same partitions.
    """
    rows = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    # the low 33 bits are the row's number within its partition
    return stage(rows.withColumns({PART: F.spark_partition_id(), ROW: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ranged")


def same(left: str, right: str, columns: list[str]) -> Column:
    """Equality of columns of two aliased sides, null with null."""
    return functools.reduce(lambda a, b: a & b, [F.col(f"{left}.`{c}`").eqNullSafe(F.col(f"{right}.`{c}`")) for c in columns])


def numbered(df: DataFrame, by: list[str], order: list[str], weight: str | None = None) -> DataFrame:
    """df with `_at`, each row's place (from 0) among its key's rows, and `_n`, their number.

    With `weight`, a whole number, a row stands for so many: _at is the first one's place. Partitions are summed up to
    a row for each key and partition; windows go over those, and over one partition's rows.
    """
    rows = ranged(df, by, order)
    one = F.col(weight) if weight else F.lit(1)
    ends = rows.groupBy(*by, PART).agg(F.sum(one).alias("_sum"), F.min(ROW).alias("_first"))
    keys = Window.partitionBy(*by)
    ends = ends.select(*by, PART, "_first", (F.sum("_sum").over(keys.orderBy(PART)) - F.col("_sum")).alias("_before"), F.sum("_sum").over(keys).alias("_n"))
    rows = rows.alias("_l").join(ends.alias("_r"), same("_l", "_r", [*by, PART])).select("_l.*", "_r._first", "_r._before", "_r._n")
    if weight:
        here = F.sum(weight).over(Window.partitionBy(*by, PART).orderBy(ROW)) - F.col(weight)
    else:
        here = F.col(ROW) - F.col("_first")
    return rows.withColumn("_at", (here + F.col("_before")).cast("long")).drop(PART, ROW, "_first", "_before")
