"""Queries that use this package's operators, functions and streams, with their DuckDB twins."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe import functions as L
from loomframe import operators as O
from loomframe import streaming
from loomframe.sources import read, read_table, stream, write
from loomframe.sources.stages import temporary


def asof_purchase_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    clicks = events.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"), F.col("value").alias("click_value"))
    return O.asof_join(events.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, "ts", ["user_id"], ["click_id", "click_value"])


def interval_error_after_signup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    signups = events.where("event_type = 'signup'").select("user_id", F.col("event_id").alias("signup_id"), F.col("at").alias("since"))
    day = 86_400_000_000
    pairs = O.interval_join(events.where("event_type = 'error'"), signups, ["user_id"], F.col("at"), F.col("since"), F.col("since") + day, day)
    return pairs.select("event_id", "signup_id", "user_id")


def salted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_orderkey", "l_linenumber", "l_quantity")
    suppliers = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_nationkey")
    joined = O.salted_join(lines, suppliers, ["s_suppkey"], 8)
    return joined.groupBy("s_nationkey").agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("n"))


def groups_frame_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    month = F.date_trunc("month", "o_orderdate")
    return O.groups_frame(orders, ["o_orderpriority"], "o_orderdate", 2, 0, {"n": F.count(F.lit(1))}, coarse=month).select("o_orderkey", "n")


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ranks over five priorities: months of a priority are ranked apart, so no task sorts a whole one."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    out = O.ranked(orders, ["o_orderpriority"], "o_orderdate", F.date_trunc("month", "o_orderdate"), ["o_orderkey"], tiles=4)
    return out.select("o_orderkey", F.col("rank").alias("r"), F.col("dense_rank").alias("d"), F.col("ntile").alias("q"), F.round("percent_rank", 9).alias("p"), F.round("cume_dist", 9).alias("c"))


def qualify_first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return O.top_k(events, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], 2)


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.sessionize(read_table(spark, sf_dir, "events").select("user_id", "ts", "value"), ["user_id"], "ts", 3600)
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("opened"), F.round(F.sum("value"), 2).alias("total"))


def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = O.windowed(read_table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], {"n": F.count(F.lit(1)), "top": F.max("value")})
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = O.windowed(read_table(spark, sf_dir, "events"), "ts", "2 hours", [], {"n": F.count(F.lit(1))}, "1 hour")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def filled_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").where("event_type = 'signup'").withColumn("day", F.to_date("ts"))
    daily = events.groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("n"))
    return O.gap_fill(daily, ["user_id"], "day", "1 day", ["n"]).withColumn("day", F.col("day").cast("string"))


def signup_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    return O.funnel(events, ["user_id"], "ts", "event_type", ["signup", "click", "purchase"], 2 * 86_400)


def word_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.tokens(read_table(spark, sf_dir, "benchmark"), ["item_id"], "text")


def trimmed_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of each type without its lowest and highest tenth, by row numbers that are dealt over runs of values."""
    events = read_table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    rows = O.ranked(events, ["event_type"], "value", F.floor(F.col("value") / 10), ["event_id"])
    counts = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    cut = F.floor(F.col("n") * 0.1)
    rows = rows.join(counts, "event_type").where((F.col("row_number") > cut) & (F.col("row_number") <= F.col("n") - cut))
    return rows.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"))


def gcd_lcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("p_partkey"), F.col("p_size").cast("long")
    return read_table(spark, sf_dir, "part").select("p_partkey", L.gcd(a, b).alias("g"), L.lcm(a, b).alias("l"))


def vector_to_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    pairs = rows.join(first, "label")
    v, w = F.col("embedding"), F.col("first")
    return pairs.select("vec_id", F.round(L.cosine(v, w), 6).alias("cosine"), F.round(L.l2_distance(v, w), 6).alias("distance"), F.round(L.dot(v, w), 6).alias("product"))


def _streamed(spark: SparkSession, build, mode: str, every: str | None = None) -> DataFrame:
    place = temporary(spark, "stream")
    return streaming.run_available(build, f"{place}/out", f"{place}/state", mode, every)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read_table(spark, sf_dir, "events").schema
    return stream(spark, f"{sf_dir.rstrip('/')}/events.parquet*", schema)


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended windows: those that the watermark has closed."""
    out = streaming.window_sums(_events(spark, sf_dir), "ts", "1 hour", ["event_type"], {"n": F.count(F.lit(1)), "top": F.max("value")}, "1 hour")
    out = _streamed(spark, out, "append")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "top")


def stream_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream without state, triggered every second."""
    return _streamed(spark, _events(spark, sf_dir).where("event_type = 'error' and value > 100").select("event_id", "value"), "append", "1 second")


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streaming.window_sums(_events(spark, sf_dir), "ts", "2 hours", [], {"n": F.count(F.lit(1))}, "1 hour", "1 hour")
    return _streamed(spark, out, "append").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


def stream_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete mode, for a result of few rows that is wanted whole."""
    out = streaming.window_sums(_events(spark, sf_dir), "ts", "1 day", [], {"n": F.count(F.lit(1))}, "1 hour")
    return _streamed(spark, out, "complete").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "n")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _streamed(spark, streaming.session_counts(_events(spark, sf_dir), "ts", "1 hour", ["user_id"], "1 hour"), "append")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("opened"), F.col("session_end").cast("timestamp_ntz").alias("closed"), "n")


def stream_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream joined with a stream: errors within an hour after a signup of the same user."""
    signups = _events(spark, sf_dir).where("event_type = 'signup'").select("user_id", F.col("ts").alias("since"), F.col("event_id").alias("signup_id"))
    errors = _events(spark, sf_dir).where("event_type = 'error'").select("user_id", "ts", "event_id")
    out = _streamed(spark, streaming.interval_pairs(signups, errors, "user_id", "since", "ts", "1 hour", "1 hour"), "append")
    return out.select("signup_id", "event_id")


def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed state in update mode: each user's last totals."""
    out = _streamed(spark, streaming.running_totals(_events(spark, sf_dir), "user_id", "value"), "update")
    last = out.groupBy("user_id").agg(F.max(F.struct("n", "total", "top")).alias("s"))
    return last.select("user_id", "s.n", F.round("s.total", 2).alias("total"), "s.top")


def stream_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed state by transformWithState: how often each user's event type changed."""
    with streaming.rocksdb(spark):
        out = _streamed(spark, streaming.type_changes(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type"), "update")
    return out.groupBy("user_id").agg(F.max("changes").alias("changes"))


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _streamed(spark, streaming.deduplicated(_events(spark, sf_dir).select("event_id", "ts", "user_id"), "ts", ["event_id"], "1 hour"), "append")
    return out.select("event_id", "user_id")


def _round_trip(spark: SparkSession, df: DataFrame, kind: str, **options: str) -> DataFrame:
    path = temporary(spark, "format")
    write(df, path, kind, **options)
    return read(spark, path, kind, df.schema, **options)


def format_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written and read back in each format; xml and text as well."""
    rows = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    out = [_round_trip(spark, rows, kind).select(F.lit(kind).alias("kind"), "n_nationkey", "n_name") for kind in ("parquet", "orc", "json", "csv")]
    out.append(_round_trip(spark, rows, "xml", rowTag="row").select(F.lit("xml").alias("kind"), "n_nationkey", "n_name"))
    lines = _round_trip(spark, rows.select(F.concat_ws("|", "n_nationkey", "n_name").alias("value")), "text")
    parts = F.split("value", r"\|")
    out.append(lines.select(F.lit("text").alias("kind"), parts[0].cast("int").alias("n_nationkey"), parts[1].alias("n_name")))
    return functools.reduce(DataFrame.unionByName, out)


def partitioned_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written by status, read back with the partitions pruned to one."""
    path = temporary(spark, "format")
    write(read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), path, partition_by=("o_orderstatus",))
    return read(spark, path).where("o_orderstatus = 'P'").select("o_orderkey", "o_orderstatus")


QUERIES = {f.__name__: f for f in (
    asof_purchase_click, interval_error_after_signup, salted_lines, groups_frame_orders, qualify_first_events, sessions, tumbling_windows, sliding_windows,
    filled_days, signup_funnel, ranks, word_rows, trimmed_means, gcd_lcm, vector_to_first, stream_tumbling, stream_filtered, stream_sliding, stream_complete, stream_sessions, stream_pairs, stream_totals,
    stream_transitions, stream_dedup, format_round_trips, partitioned_output,
)}

_TUMBLING = "select date_trunc('hour', ts) as window_start, event_type, count(*) as n, max(value) as top from events group by 1, 2"

SQL = {
    "asof_purchase_click": """
        select p.event_id, p.user_id, p.ts, c.event_id as click_id, c.value as click_value
        from (select * from events where event_type = 'purchase') p
        asof left join (select * from events where event_type = 'click') c on p.user_id = c.user_id and p.ts >= c.ts""",
    "interval_error_after_signup": """
        select e.event_id, s.event_id as signup_id, e.user_id from events e join events s on e.user_id = s.user_id
        where e.event_type = 'error' and s.event_type = 'signup' and e.ts between s.ts and s.ts + interval 1 day""",
    "salted_lines": "select s_nationkey, sum(l_quantity) as quantity, count(*) as n from lineitem join supplier on l_suppkey = s_suppkey group by 1",
    "groups_frame_orders": """
        select o_orderkey, count(*) over (partition by o_orderpriority order by o_orderdate groups between 2 preceding and current row) as n from orders""",
    "qualify_first_events": """
        select event_id, user_id, ts, event_type from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) <= 2""",
    "sessions": """
        with o as (select user_id, ts, value, coalesce((ts - lag(ts) over (partition by user_id order by ts) > interval 1 hour)::int, 1) as opens from events),
        s as (select user_id, ts, value, sum(opens) over (partition by user_id order by ts)::bigint as session from o)
        select user_id, session, count(*) as n, min(ts) as opened, round(sum(value), 2) as total from s group by 1, 2""",
    "tumbling_windows": _TUMBLING,
    "sliding_windows": """
        select w as window_start, count(*) as n from (select unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as w from events) group by 1""",
    "filled_days": """
        with daily as (select user_id, ts::date as day, count(*) as n from events where event_type = 'signup' group by 1, 2),
        grid as (select user_id, unnest(generate_series(min(day), max(day), interval 1 day))::date as day from daily group by user_id)
        select user_id, day::string as day, last_value(n ignore nulls) over (partition by user_id order by day) as n from grid left join daily using (user_id, day)""",
    "signup_funnel": """
        with s as (select user_id, ts from events where event_type = 'signup'),
        a as (select s.user_id, s.ts, min(c.ts) as c from s left join events c on c.user_id = s.user_id and c.event_type = 'click' and c.ts >= s.ts group by all),
        b as (select a.user_id, a.ts, a.c, min(p.ts) as p from a left join events p on p.user_id = a.user_id and p.event_type = 'purchase' and p.ts >= a.c group by all),
        r as (select user_id, 1 + (c - ts <= interval 2 day)::int + (p - ts <= interval 2 day)::int as reached from (select user_id, ts, coalesce(c, ts + interval 9 day) as c, coalesce(p, ts + interval 9 day) as p from b))
        select u.user_id, coalesce(max(reached), 0)::int as reached from (select distinct user_id from events) u left join r using (user_id) group by 1""",
    "word_rows": """
        with w as (select item_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') as ws from benchmark)
        select item_id, (k - 1)::int as place, ws[k] as token from w, unnest(range(1, len(ws) + 1)) as r(k)""",
    "trimmed_means": """
        with r as (select event_type, value, row_number() over (partition by event_type order by value) as k, count(*) over (partition by event_type) as n from events)
        select event_type, round(avg(value), 6) as mean from r where k > floor(n * 0.1) and k <= n - floor(n * 0.1) group by 1""",
    "gcd_lcm": "select p_partkey, gcd(p_partkey, p_size)::bigint as g, lcm(p_partkey, p_size)::bigint as l from part",
    "vector_to_first": """
        with f as (select label, arg_min(embedding, vec_id) as first from embeddings group by 1)
        select vec_id, round(list_cosine_similarity(embedding::double[], first::double[]), 6) as cosine,
          round(list_distance(embedding::double[], first::double[]), 6) as distance, round(list_inner_product(embedding::double[], first::double[]), 6) as product
        from embeddings join f using (label)""",
    "ranks": """
        select o_orderkey, rank() over w as r, dense_rank() over w as d, ntile(4) over (partition by o_orderpriority order by o_orderdate, o_orderkey)::int as q,
          round(percent_rank() over w, 9) as p, round(cume_dist() over w, 9) as c
        from orders window w as (partition by o_orderpriority order by o_orderdate)""",
    "stream_tumbling": f"select * from ({_TUMBLING}) where window_start + interval 1 hour <= (select max(ts) - interval 1 hour from events)",
    "stream_filtered": "select event_id, value from events where event_type = 'error' and value > 100",
    "stream_sliding": """
        select w as window_start, count(*) as n from (select unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) as w from events)
        where w + interval 2 hour <= (select max(ts) - interval 1 hour from events) group by 1""",
    "stream_complete": "select date_trunc('day', ts)::timestamp as window_start, count(*) as n from events group by 1",
    "stream_sessions": """
        with o as (select user_id, ts, coalesce((ts - lag(ts) over (partition by user_id order by ts) >= interval 1 hour)::int, 1) as opens from events),
        s as (select user_id, ts, sum(opens) over (partition by user_id order by ts) as session from o)
        select user_id, min(ts) as opened, max(ts) + interval 1 hour as closed, count(*) as n from s group by user_id, session
        having max(ts) + interval 1 hour <= (select max(ts) - interval 1 hour from events)""",
    "stream_pairs": """
        select s.event_id as signup_id, e.event_id from events s join events e on s.user_id = e.user_id
        where s.event_type = 'signup' and e.event_type = 'error' and e.ts between s.ts and s.ts + interval 1 hour""",
    "stream_totals": "select user_id, count(value) as n, round(sum(value), 2) as total, max(value) as top from events group by 1",
    "stream_transitions": """
        select user_id, sum(changed)::bigint as changes from (select user_id, coalesce((event_type <> lag(event_type) over (partition by user_id order by ts, event_id))::int, 0) as changed from events) group by 1""",
    "format_round_trips": "select kind, n_nationkey, n_name from nation, unnest(['parquet', 'orc', 'json', 'csv', 'xml', 'text']) as k(kind)",
    "partitioned_output": "select o_orderkey, o_orderstatus from orders where o_orderstatus = 'P'",
    "stream_dedup": "select distinct event_id, user_id from events",
}
