"""As-of, interval and salted joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str]) -> DataFrame:
    """Each left row with `values` of the last right row of its `by` keys at or before it in `on`.

    One shuffle on the keys and one sort: the sides are stacked and the last right row is carried
    forward, so the cost is linear where a join on an inequality is quadratic. Ties of right rows
    are settled by the values' order; left rows without a match have nulls. A null key or time matches nothing.
    """
    for c in (on, *by):
        right = right.where(F.col(c).isNotNull())
    names = left.columns
    pack = F.struct(*[F.col(v) for v in values])
    lhs = left.select(*by, on, F.lit(1).alias("_side"), F.struct(*names).alias("_row"), F.lit(None).cast(right.select(pack.alias("p")).schema["p"].dataType).alias("_value"))
    rhs = right.select(*by, on, F.lit(0).alias("_side"), F.lit(None).cast(lhs.schema["_row"].dataType).alias("_row"), pack.alias("_value"))
    seen = Window.partitionBy(*by).orderBy(on, "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    stacked = lhs.unionByName(rhs).withColumn("_last", F.last("_value", ignorenulls=True).over(seen))
    return stacked.where("_side = 1").select("_row.*", *[F.col(f"_last.{v}").alias(v) for v in values])


def interval_join(left: DataFrame, right: DataFrame, by: list[str], at: Column, start: Column, end: Column, width: float) -> DataFrame:
    """Pairs with equal keys and start <= at <= end, by buckets of `width` on the axis.

    `at` is of the left side, `start` and `end` of the right; all numbers. A right row is repeated for
    each bucket it spans, so a width near the usual length keeps that near two; each pair meets in
    one bucket only. The join is an equi-join, which shuffles by key and bucket and splits if skewed.
    """
    lhs = left.withColumn("_b", F.floor(at / width)).withColumn("_at", at)
    rhs = right.withColumns({"_lo": start, "_hi": end}).where("_lo <= _hi")
    rhs = rhs.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))))
    return lhs.join(rhs, [*by, "_b"]).where("_at between _lo and _hi").drop("_b", "_at", "_lo", "_hi")


def not_in(left: DataFrame, column: str, right: DataFrame, other: str) -> DataFrame:
    """Left rows whose column is NOT IN the right's: none if the right has a null, all if it has no row.

    Spark plans single-column NOT IN as a broadcast of the right side whatever its size; here it is a
    plain anti join, with the right's nulls counted apart.
    """
    counts = right.agg(F.count(F.lit(1)).alias("_rows"), F.count(other).alias("_full"))
    kept = left.join(right.select(F.col(other).alias("_other")).where("_other is not null"), F.col(column) == F.col("_other"), "left_anti")
    # counts is one row.
    fits = (F.col("_rows") == 0) | ((F.col("_rows") == F.col("_full")) & F.col(column).isNotNull())
    return kept.join(F.broadcast(counts)).where(fits).drop("_rows", "_full")


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salts: int, how: str = "inner") -> DataFrame:
    """A join whose left side has hot keys: left rows spread over `salts`, right rows are repeated that often."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("the repeated side can't be kept whole")
    lhs = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    rhs = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return lhs.join(rhs, [*on, "_salt"], how).drop("_salt")
