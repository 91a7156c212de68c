"""Event-time operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessionize(df: DataFrame, by: list[str], ts: str, gap_seconds: int) -> DataFrame:
    """df with `session`, from 1 for each key: a row later than the gap after the one before opens one."""
    order = Window.partitionBy(*by).orderBy(ts)
    seconds = F.col(ts).cast("timestamp").cast("double")
    opens = F.coalesce((seconds - F.lag(seconds).over(order) > gap_seconds).cast("int"), F.lit(1))
    return df.withColumn("_opens", opens).withColumn("session", F.sum("_opens").over(order.rangeBetween(Window.unboundedPreceding, 0))).drop("_opens")


def windowed(df: DataFrame, ts: str, length: str, by: list[str], aggregates: dict[str, Column], slide: str | None = None) -> DataFrame:
    """Tumbling or sliding windows with window_start; one shuffle, with partial sums before it."""
    frame = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = df.groupBy(frame.alias("_w"), *by).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("_w.start").alias("window_start"), *by, *aggregates)


def gap_fill(df: DataFrame, by: list[str], bucket: str, step: str, values: list[str]) -> DataFrame:
    """One row for each step from a key's first to its last bucket; missing values carry the last one forward."""
    spans = df.groupBy(*by).agg(F.min(bucket).alias("_a"), F.max(bucket).alias("_b"))
    grid = spans.select(*by, F.explode(F.expr(f"sequence(_a, _b, interval {step})")).alias(bucket))
    order = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(df, [*by, bucket], "left").withColumns({v: F.last(v, ignorenulls=True).over(order) for v in values})
