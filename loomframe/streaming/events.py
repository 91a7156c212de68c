"""Streams of events: windows, sessions, dedup and interval joins under watermarks.

Event time must be a TIMESTAMP; the tables' TIMESTAMP_NTZ is cast first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def window_sums(events: DataFrame, ts: str, length: str, by: list[str], aggregates: dict[str, Column], late: str, slide: str | None = None) -> DataFrame:
    frame = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = timed(events, ts, late).groupBy(frame.alias("w"), *by).agg(*[c.alias(n) for n, c in aggregates.items()])
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, *aggregates)


def session_counts(events: DataFrame, ts: str, gap: str, by: list[str], late: str) -> DataFrame:
    out = timed(events, ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")


def deduplicated(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    return timed(events, ts, late).dropDuplicatesWithinWatermark(keys)


def interval_pairs(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, within: str, late: str, how: str = "inner") -> DataFrame:
    """Pairs of a key whose right time is at most `within` after the left; both sides' state ends with the watermark.

    With `how` left_outer, a left row without a pair comes once its state ends, as no right row can come any more."""
    r = timed(right, right_ts, late).withColumnRenamed(by, "_by")
    later = F.col(right_ts).between(F.col(left_ts), F.col(left_ts) + F.expr(f"interval {within}"))
    return timed(left, left_ts, late).join(r, (F.col(by) == F.col("_by")) & later, how).drop("_by")


def enriched(stream: DataFrame, static: DataFrame, by: str) -> DataFrame:
    """Each row of a stream with those of a table, which is read as it is at each batch; without one, with nulls."""
    return stream.join(static, by, "left")


def dropped_late(query: StreamingQuery) -> int:
    """Rows that a finished query's stateful operators left out, as they came behind the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for progress in query.recentProgress for op in progress["stateOperators"])


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", every: str | None = None, done: Callable[[StreamingQuery], None] | None = None) -> DataFrame:
    """Runs a stream over what there is, into Parquet, and reads the result.

    With `every`, it is triggered at that interval and stopped when all is processed, instead of once. `done` is called
    with the finished query.

    Append writes each batch's finished rows once; update writes the rows that each batch changed. Complete
    replaces the table with each batch.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", path).start()
    else:
        how = "overwrite" if mode == "complete" else "append"
        query = writer.foreachBatch(lambda batch, _: batch.write.mode(how).parquet(path)).start()
    if every:
        query.processAllAvailable()
        query.stop()
    query.awaitTermination()
    if done:
        done(query)
    return spark.read.schema(stream.schema).parquet(path)
