"""As-of joins in any direction, with a tolerance, whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.operators.ranges import PART, ranged, same

DIRECTIONS = ("backward", "forward", "nearest")


def asof(left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], direction: str = "backward", tolerance: float | None = None, exact: bool = True) -> DataFrame:
    """Each left row with `values` of the right row of its `by` keys that is nearest in `on`: at or before it, at or
    after it, or either (at equal distances the one before). `exact` False leaves out rows at the same place;
    `tolerance` is the largest distance, in seconds if `on` is a time. Of right rows at one place the one with the
    largest values counts. Left rows without a match have nulls; a null key or place matches nothing.

    Both sides are stacked and range-partitioned by key and place. A partition carries the last (and the next) right
    row along by itself; what the partitions of a key end with, a row each, is carried over them and joined back. So
    without keys, or with one that has all rows, every task has a part, and nothing is compared pairwise.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    pack = F.struct(F.col(on).alias("_place"), F.struct(*[F.col(f"`{v}`") for v in values]).alias("_values"))
    for c in (on, *by):
        right = right.where(F.col(f"`{c}`").isNotNull())
    # of right rows at one place one stays
    rhs = right.groupBy(*by, on).agg(F.max(F.struct(*[F.col(f"`{v}`") for v in values])).alias("_v")).select(*by, on, *[F.col(f"_v.`{v}`").alias(v) for v in values])
    names = left.columns
    rhs = rhs.select(*by, on, pack.alias("_right"))
    lhs = left.select(*by, on, F.struct(*[F.col(f"`{c}`") for c in names]).alias("_left"))
    both = lhs.unionByName(rhs, allowMissingColumns=True)
    # At one place the right row is met first, in the direction that is looked in; last if equal places don't count.
    back, ahead = direction != "forward", direction != "backward"
    both = both.withColumn("_is_left", F.col("_left").isNotNull().cast("int"))
    sought = {}
    if back:
        sought["_back"] = 1 if exact else -1
    if ahead:
        sought["_ahead"] = 1 if exact else -1
    rows = ranged(both.withColumns({c: F.col("_is_left") * sign * (1 if c == "_back" else -1) for c, sign in sought.items()}), by, [on])
    joined = rows
    for c in sought:
        joined = _carried(joined, by, on, c, forward=c == "_ahead")
    hits = [F.col(f"{c}_hit") for c in sought]
    time = dict(left.dtypes)[on].startswith(("timestamp", "date"))
    number = lambda x: F.unix_micros(x.cast("timestamp")) if time else x
    apart = lambda hit: F.abs(number(F.col(f"_left.`{on}`")) - number(hit["_place"]))
    if direction == "nearest":
        hit = F.when(hits[1].isNull() | (apart(hits[0]) <= apart(hits[1])), hits[0]).otherwise(hits[1])
        hit = F.when(hits[0].isNull(), hits[1]).otherwise(hit)
    else:
        hit = hits[0]
    joined = joined.where("_is_left = 1").withColumn("_hit", hit)
    there = F.col("_hit").isNotNull()
    for c in (on, *by):
        there = there & F.col(f"_left.`{c}`").isNotNull()
    if tolerance is not None:
        there = there & (apart(F.col("_hit")) <= tolerance * (1_000_000 if time else 1))
    return joined.select(*[F.col(f"_left.`{c}`").alias(c) for c in names], *[F.when(there, F.col(f"_hit._values.`{v}`")).alias(v) for v in values])


def _carried(rows: DataFrame, by: list[str], on: str, ties: str, forward: bool) -> DataFrame:
    """rows with `{ties}_hit`: the right row that is last before each row, or first after it, in the order of place and ties."""
    down = F.col(on).desc() if forward else F.col(on).asc()
    first = F.col(ties).desc() if forward else F.col(ties).asc()
    part = Window.partitionBy(*by, PART).orderBy(down, first).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn(f"{ties}_near", F.last("_right", ignorenulls=True).over(part))
    # the right row that a partition hands on to those after it
    ends = rows.where("_right is not null").groupBy(*by, PART).agg((F.min if forward else F.max)("_right").alias("_end"))
    parts = rows.select(*by, PART).distinct().alias("_l").join(ends.alias("_r"), same("_l", "_r", [*by, PART]), "left").select("_l.*", "_r._end")
    over = Window.partitionBy(*by).orderBy(F.col(PART).desc() if forward else F.col(PART)).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_far", F.last("_end", ignorenulls=True).over(over)).drop("_end")
    out = local.alias("_l").join(parts.alias("_r"), same("_l", "_r", [*by, PART])).select("_l.*", F.col("_r._far").alias(f"{ties}_far"))
    return out.withColumn(f"{ties}_hit", F.coalesce(f"{ties}_near", f"{ties}_far"))

