"""Joins of intervals with intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of one level are within this factor of each other.
FACTOR = 8


def overlap_join(left: DataFrame, right: DataFrame, by: list[str], left_ends: tuple[Column, Column], right_ends: tuple[Column, Column]) -> DataFrame:
    """Pairs of rows with equal `by` keys whose closed intervals [start, end] share a point; whole numbers.

    Two intervals share a point if the later start lies in the other one. So the join is two of points in intervals:
    right starts in left intervals, and left starts in right intervals that start earlier; no pair is in both. An
    interval belongs to the level of its length, FACTOR ** level, and stands in the one or two buckets of that width
    that it touches. A start stands in its bucket of each level that the other side has, which are few: 22 at most for
    64-bit lengths, found by a small aggregation first. So the rows sent are a constant times the intervals, however
    short and long ones are mixed, and a pair meets in one bucket. The join is an equi-join, which splits if skewed.
    Intervals that end before they start, and nulls in keys or ends, meet none.
    """

    def framed(df: DataFrame, ends: tuple[Column, Column], row: str) -> DataFrame:
        out = df.select(*[F.col(f"`{c}`").alias(f"_key{k}") for k, c in enumerate(by)], F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(row), ends[0].cast("long").alias("_start"), ends[1].cast("long").alias("_end"))
        return out.where("_start <= _end").withColumn("_level", level(F.col("_end") - F.col("_start")))

    keys = [f"_key{k}" for k in range(len(by))]
    lhs, rhs = framed(left, left_ends, "_l"), framed(right, right_ends, "_r")
    later = _starts_within(lhs, rhs, keys, "_l", "_r", F.col("_point") >= F.col("_start"))
    earlier = _starts_within(rhs, lhs, keys, "_r", "_l", F.col("_point") > F.col("_start"))
    pairs = later.unionByName(earlier)
    shared = [c for c in right.columns if c not in by]
    if clash := set(shared) & set(left.columns):
        raise ValueError(f"columns of both sides: {sorted(clash)}")
    return pairs.select(*[F.col(f"_l.`{c}`").alias(c) for c in left.columns], *[F.col(f"_r.`{c}`").alias(c) for c in shared])


def level(length: Column) -> Column:
    """The least level whose width, FACTOR ** level, is more than the length: so an interval touches two buckets at most."""
    return sum(((length >= FACTOR**k).cast("int") for k in range(21)), F.lit(0))


def _starts_within(intervals: DataFrame, others: DataFrame, keys: list[str], row: str, other: str, order: Column) -> DataFrame:
    """(row, other): rows of `intervals` with those of `others` that start in them, where `order` holds."""
    levels = [r[0] for r in intervals.select("_level").distinct().collect()]  # 22 at most
    spread = intervals.select(*keys, row, "_start", "_end", "_level", F.explode(F.array_distinct(F.array(_bucket("_start"), _bucket("_end")))).alias("_bucket"))
    points = others.select(*keys, other, F.col("_start").alias("_point"), F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")).alias("_level"))
    points = points.withColumn("_bucket", _bucket("_point"))
    met = spread.join(points, [*keys, "_level", "_bucket"])
    return met.where(order & (F.col("_point") <= F.col("_end"))).select(row, other)


def _bucket(at: str) -> Column:
    """The number of the bucket of the row's level that a whole number lies in; exact for negative ones, too."""
    return F.call_function("shiftright", F.col(at), F.col("_level") * (FACTOR.bit_length() - 1))
