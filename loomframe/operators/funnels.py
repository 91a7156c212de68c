"""Ordered event steps within a time limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def funnel(df: DataFrame, by: list[str], ts: str, kind: str, steps: list[str], within_seconds: int) -> DataFrame:
    """(by, reached): how many of the steps each key did in order, all within the limit of a first step.

    A step's earliest time after the step before it is carried back from later rows by one window
    a step, all over the same partitioning and order: one shuffle, one sort. The best start counts.
    Equal times count as in order. Keys that never did the first step have 0.
    """
    seconds = F.col(ts).cast("timestamp").cast("double")
    later = Window.partitionBy(*by).orderBy("_at").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    rows = df.select(*by, seconds.alias("_at"), F.col(kind).alias("_kind"))
    # _path: the times of this row's step and of the steps after it, each at its earliest
    for k in range(len(steps) - 1, -1, -1):
        here = F.col("_kind") == steps[k]
        if k == len(steps) - 1:
            path = F.when(here, F.array(F.col("_at")))
        else:
            path = F.when(here, F.concat(F.array(F.col("_at")), F.coalesce(F.col("_next"), F.array().cast("array<double>"))))
        rows = rows.withColumn("_path", path)
        if k:
            rows = rows.withColumn("_next", F.first("_path", ignorenulls=True).over(later))
    first = F.get("_path", 0)
    done = F.size(F.filter("_path", lambda t: t - first <= within_seconds))
    return rows.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("_path").isNotNull(), done)), F.lit(0)).alias("reached"))
