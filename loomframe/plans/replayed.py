"""Streams over files that are replayed, some of their rows late, and over the commits of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe import streaming
from loomframe.sources import read_committed, read_table, replay, stream_committed, write_committed
from loomframe.sources.stages import temporary

#: Batches of three days; late rows come three batches after their own, well behind the watermark.
SLICES, LATE_BY = 10, 3
_LATE = "event_id % 20 = 0"


def _replayed(spark: SparkSession, sf_dir: str, late: bool) -> DataFrame:
    events = read_table(spark, sf_dir, "events")
    if late:
        own = F.least(F.floor((F.dayofmonth("ts") - 1) / 3), F.lit(SLICES - 1))
        return replay(events, own, SLICES, F.expr(_LATE), LATE_BY)
    # equal parts of the time from the first to the last row, so that no slice is behind another whatever the months
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(micros), F.max(micros)).first()
    return replay(events, F.floor((micros - (first or 0)) / ((last or 0) - (first or 0) + 1) * SLICES), SLICES)


def _run(spark: SparkSession, stream: DataFrame, mode: str, done=None) -> DataFrame:
    place = temporary(spark, "stream")
    return streaming.run_available(stream, f"{place}/out", f"{place}/state", mode, done=done)


def stream_outer_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups with the same user's errors within an hour after them, or with none: the batch answer of all rows but the
    late ones, whose number stands beside it."""
    events, seen = _replayed(spark, sf_dir, late=True), []
    signups = events.where("event_type = 'signup'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("signup_id"))
    errors = events.where("event_type = 'error'").select("user_id", "ts", "event_id")
    pairs = streaming.interval_pairs(signups, errors, "user_id", "since", "ts", "1 hour", "1 hour", "left_outer").select("signup_id", "event_id")
    out = _run(spark, pairs, "append", lambda query: seen.append(streaming.dropped_late(query)))
    return out.withColumn("dropped", F.lit(seen[0]).cast("long"))


def stream_windows_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by hour and type of replayed events: windows that the watermark closed, without late rows."""
    out = streaming.window_sums(_replayed(spark, sf_dir, late=True), "ts", "1 hour", ["event_type"], {"n": F.count(F.lit(1))}, "1 hour")
    return _run(spark, out, "append").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def stream_static(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of a stream with the customers of a table; late rows count, as there is no state."""
    customers = read_table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    purchases = _replayed(spark, sf_dir, late=True).where("event_type = 'purchase'").select("user_id", "event_id")
    return _run(spark, streaming.enriched(purchases, customers, "user_id"), "append").select("event_id", "user_id", "c_mktsegment")


def stream_timed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that end by an inactivity timer, with a map of their events' types."""
    with streaming.rocksdb(spark):
        out = _run(spark, streaming.timed_sessions(_replayed(spark, sf_dir, late=False), "user_id", "ts", "event_type", "1 hour", "1 hour"), "append")
    return out.select("user_id", F.col("opened").cast("timestamp_ntz").alias("opened"), F.col("closed").cast("timestamp_ntz").alias("closed"), "n", "kinds")


def _committed(spark: SparkSession, sf_dir: str) -> str:
    """Large orders, as two commits of a table."""
    path = temporary(spark, "table")
    orders = read_committed(spark, f"{sf_dir.rstrip('/')}/orders.parquet").where("o_totalprice > 200000").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    for status in ("F", "P"):
        write_committed(orders.where(F.col("o_orderstatus") == status).repartition(4, "o_orderkey"), path)
    return path


def committed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of the data source of its own, filled from a given one; filters are pushed to both."""
    return read_committed(spark, _committed(spark, sf_dir)).where("o_totalprice <= 400000 and o_orderkey is not null")


def stream_committed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commits of such a table as a stream."""
    return _run(spark, stream_committed(spark, _committed(spark, sf_dir)).where("o_totalprice <= 400000").select("o_orderkey", "o_orderstatus"), "append")


QUERIES = {f.__name__: f for f in (committed_orders, stream_committed_orders, stream_outer_late, stream_windows_late, stream_static, stream_timed_sessions)}

_SLICE = f"least((day(ts) - 1) // 3, {SLICES - 1})"
_TIMELY = f"(select * from events where not ({_LATE} and {_SLICE} + {LATE_BY} < {SLICES}))"

SQL = {
    "committed_orders": "select o_orderkey, o_orderstatus, o_totalprice, o_orderdate from orders where o_totalprice > 200000 and o_totalprice <= 400000 and o_orderstatus in ('F', 'P')",
    "stream_committed_orders": "select o_orderkey, o_orderstatus from orders where o_totalprice > 200000 and o_totalprice <= 400000 and o_orderstatus in ('F', 'P')",
    "stream_outer_late": f"""
        with e as {_TIMELY}, s as (select * from e where event_type = 'signup'), r as (select * from e where event_type = 'error'),
        edge as (select least((select max(ts) from s), (select max(ts) from r)) - interval 1 hour as at),
        d as (select count(*) as dropped from events where event_type in ('signup', 'error') and {_LATE} and {_SLICE} + {LATE_BY} < {SLICES})
        select s.event_id as signup_id, r.event_id, dropped from s left join r on s.user_id = r.user_id and r.ts between s.ts and s.ts + interval 1 hour, edge, d
        where r.event_id is not null or s.ts + interval 1 hour < edge.at""",
    "stream_windows_late": f"""
        select date_trunc('hour', ts) as window_start, event_type, count(*) as n from {_TIMELY} where date_trunc('hour', ts) + interval 1 hour <= (select max(ts) - interval 1 hour from events) group by 1, 2""",
    "stream_static": """
        select event_id, user_id, c_mktsegment from events left join (select * from customer where c_acctbal > 0) on c_custkey = user_id where event_type = 'purchase'""",
    "stream_timed_sessions": """
        with o as (select user_id, ts, event_type, coalesce((ts - lag(ts) over (partition by user_id order by ts) >= interval 1 hour)::int, 1) as opens from events),
        s as (select user_id, ts, event_type, sum(opens) over (partition by user_id order by ts) as session from o),
        k as (select user_id, session, string_agg(event_type || ':' || n, ',' order by event_type) as kinds from (select user_id, session, event_type, count(*) as n from s group by all) group by 1, 2)
        select user_id, min(ts) as opened, max(ts) + interval 1 hour as closed, count(*) as n, any_value(kinds) as kinds from s join k using (user_id, session) group by user_id, session
        having max(ts) + interval 1 hour <= (select max(ts) - interval 1 hour from events)""",
}
