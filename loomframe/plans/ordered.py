"""Queries with recursion, row patterns, directed as-of joins, overlaps, exact quantiles and frames with EXCLUDE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomframe import operators as O
from loomframe.sources import read_table


def nation_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that goods could reach by supplies from hand to hand: from a supplier's nation to a customer's by large
    returned lines without a discount; the ways have cycles."""
    lines = read_table(spark, sf_dir, "lineitem").where("l_quantity >= 49 and l_discount = 0 and l_returnflag = 'R'").select("l_suppkey", "l_orderkey")
    suppliers = read_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("l_suppkey"), F.col("s_nationkey").alias("giver"))
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("taker"))
    edges = lines.join(suppliers, "l_suppkey").join(orders, "l_orderkey").join(customers, "c_custkey").select("giver", "taker")
    return O.closure(edges, "giver", "taker")


def part_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many orders apart each part is from the first one, if an order links the parts of lines that follow each other."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    ahead = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("next_part"))
    edges = lines.join(ahead, ["l_orderkey", "l_linenumber"]).select("l_partkey", "next_part")
    return O.distances(edges, "l_partkey", "next_part", lines.agg(F.min("l_partkey").alias("part")))


def order_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as hierarchies: an order's parent is the customer's order before it, if that is at most 60 days old."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    own = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    days = F.datediff("o_orderdate", F.lag("o_orderdate").over(own))
    linked = orders.withColumn("parent", F.when(days <= 60, F.lag("o_orderkey").over(own)))
    found = O.hierarchy(linked, "o_orderkey", "parent", "o_totalprice")
    return found.select(F.col("node").alias("o_orderkey"), F.col("root").alias("first_order"), "level", F.round("total", 2).alias("total"))


#: Symbols of the event types.
_KINDS = {"C": "click", "E": "error", "P": "purchase", "S": "signup", "V": "view"}


def _pattern(spark: SparkSession, sf_dir: str, pattern: str, by: list[str]) -> DataFrame:
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    symbols = {s: F.col("event_type") == kind for s, kind in _KINDS.items()}
    measures = {"first_id": F.min("event_id"), "last_id": F.max("event_id"), "n": F.count(F.lit(1)), "errors": F.count_if(F.col("symbol") == "E"), "total": F.round(F.sum("value"), 2)}
    return O.match_rows(events, by, ["ts", "event_id"], symbols, pattern, measures)


def pattern_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors, one or more, and then a signup, of one user."""
    return _pattern(spark, sf_dir, "E+S", ["user_id"])


def pattern_alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A click, views or errors, and a purchase, over all users together: one sequence of all events."""
    return _pattern(spark, sf_dir, "C(V|E)+P", [])


def pattern_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A signup and then a purchase with three other events between them at most, of one user."""
    return _pattern(spark, sf_dir, "S(C|E|V){0,3}P", ["user_id"])


def _two_kinds(spark: SparkSession, sf_dir: str, kind: str, other: str) -> tuple[DataFrame, DataFrame]:
    events = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return events.where(F.col("event_type") == kind).select("event_id", "user_id", "ts"), events.where(F.col("event_type") == other).select("user_id", "ts", F.col("event_id").alias("other_id"), F.col("value").alias("other_value"))


def asof_next_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each signup the same user's next purchase, within five days."""
    left, right = _two_kinds(spark, sf_dir, "signup", "purchase")
    return O.asof(left, right, "ts", ["user_id"], ["other_id", "other_value"], "forward", tolerance=5 * 86_400)


def asof_nearest_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each click the nearest error of anyone, before or after it: no key, so all rows are one group."""
    left, right = _two_kinds(spark, sf_dir, "click", "error")
    return O.asof(left, right.drop("user_id"), "ts", [], ["other_id", "other_value"], "nearest")


def asof_last_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each purchase the last view of anyone before it, within ten minutes."""
    left, right = _two_kinds(spark, sf_dir, "purchase", "view")
    return O.asof(left, right.drop("user_id"), "ts", [], ["other_id", "other_value"], "backward", tolerance=600, exact=False)


def overlapping_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and new lines of a part whose ways overlap: first lines are two years on the way, others a day for each piece."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", F.datediff("l_shipdate", F.lit("1970-01-01")).alias("day"))
    last = F.col("day") + F.when(F.col("l_linenumber") == 1, 730).otherwise(F.col("l_quantity").cast("int"))
    lines = lines.withColumn("last", last)
    side = lambda flag, p: lines.where(F.col("l_returnflag") == flag).select(F.col("l_partkey"), *[F.col(c).alias(p + c) for c in ("l_orderkey", "day", "last")])
    pairs = O.overlap_join(side("A", "a_"), side("N", "n_"), ["l_partkey"], (F.col("a_day"), F.col("a_last")), (F.col("n_day"), F.col("n_last")))
    shared = F.least("a_last", "n_last") - F.greatest("a_day", "n_day") + 1
    return pairs.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("pairs"), F.sum(shared).alias("days"), F.sum(F.col("a_l_orderkey") - F.col("n_l_orderkey")).alias("apart"))


def within_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    quarter = O.quantiles(lines, ["l_returnflag"], "l_quantity", {"q1": 0.25})
    return quarter.join(O.quantiles(lines, ["l_returnflag"], "l_extendedprice", {"m": 0.5}, discrete=True), "l_returnflag")


def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").select("l_linenumber", "l_quantity")
    found = O.quantiles(lines, ["l_linenumber"], "l_quantity", {"med": 0.5})
    return found.join(lines.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("n")), "l_linenumber")


def approximate_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether approximate percentiles are near the exact ones, which are picked from range partitions."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    found = lines.groupBy("l_returnflag").agg(F.approx_percentile("l_quantity", 0.5, 10000).alias("a"), F.percentile_approx("l_extendedprice", 0.9, 10000).alias("b"))
    mids = O.quantiles(lines, ["l_returnflag"], "l_quantity", {"m": 0.5}).withColumnRenamed("l_returnflag", "_f")
    highs = O.quantiles(lines, ["l_returnflag"], "l_extendedprice", {"h": 0.9}).withColumnRenamed("l_returnflag", "_g")
    both = found.join(mids, F.col("l_returnflag").eqNullSafe(F.col("_f"))).join(highs, F.col("l_returnflag").eqNullSafe(F.col("_g")))
    return both.select("l_returnflag", (F.abs(F.col("a") - F.col("m")) <= 1).alias("mid"), (F.abs(F.col("b") - F.col("h")) <= 0.01 * F.col("h")).alias("high"))


def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.quantiles(read_table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity"), ["l_returnflag"], "l_quantity", {"p90": 0.9})


#: Forms of EXCLUDE and the letter of their columns.
_FORMS = {"no others": "o", "current row": "c", "group": "g", "ties": "t"}


def frames_excluding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days around each event's day, of all events of its type, less what each form of EXCLUDE leaves out."""
    rows = read_table(spark, sf_dir, "events").select("event_id", "event_type", F.date_trunc("day", "ts").alias("day"), "value")
    for form, letter in _FORMS.items():
        rows = O.frame_excluding(rows, ["event_type"], "day", "value", 2, 1, form, tuple(f"{what}_{letter}" for what in ("n", "s", "lo", "hi")))
    return rows.select("event_id", *[F.round(f"{what}_{x}", 2).alias(f"{what}_{x}") if what == "s" else F.col(f"{what}_{x}") for x in _FORMS.values() for what in ("n", "s", "lo", "hi")])


QUERIES = {f.__name__: f for f in (
    nation_closure, part_distances, order_bursts, pattern_repeated, pattern_alternatives, pattern_gap, asof_next_purchase, asof_nearest_error, asof_last_view,
    overlapping_shipments, within_group, medians, approximate_percentiles, percentiles, frames_excluding,
)}


def _islands(by: str, ends: str, run: str, least: int, opener: str) -> str:
    """Matches of `opener`, then `run` events (any number from `least`), then `ends`, from the lengths of runs; no automaton."""
    keys = f"partition by {by} " if by else ""
    head = f"{by}, " if by else ""
    begins = "p - len" if not opener else "p - len - 1"
    opened = f"and lag_kind = '{opener}'" if opener else ""
    return f"""
        with e as (select *, row_number() over ({keys}order by ts, event_id) - 1 as p, event_type in ({run}) as inside from events),
        f as (select *, p - coalesce(max(case when not inside then p end) over ({keys}order by p rows between unbounded preceding and 1 preceding), -1) - 1 as len from e),
        g as (select f.*, o.event_type as lag_kind from f left join e o on {f"o.{by} = f.{by} and " if by else ""}o.p = f.p - f.len - 1),
        m as (select {head}{begins} as match_start, p as match_end from g where event_type = '{ends}' and len >= {least} {opened})
        select {f"m.{by}, " if by else ""}match_start::bigint as match_start, match_end::bigint as match_end, min(e.event_id) as first_id, max(e.event_id) as last_id, count(*) as n,
          count(*) filter (event_type = 'error') as errors, round(sum(value), 2) as total
        from m join e on {f"m.{by} = e.{by} and " if by else ""}e.p between match_start and match_end group by all"""


def _excluding() -> str:
    parts = []
    for form, x in _FORMS.items():
        w = f"over (partition by event_type order by date_trunc('day', ts) groups between 2 preceding and 1 following exclude {form})"
        parts += [f"count(value) {w} as n_{x}", f"round(sum(value) {w}, 2) as s_{x}", f"min(value) {w} as lo_{x}", f"max(value) {w} as hi_{x}"]
    return f"select event_id, {', '.join(parts)} from events"


SQL = {
    "nation_closure": """
        with recursive edges as (select distinct s_nationkey as giver, c_nationkey as taker from lineitem join supplier on s_suppkey = l_suppkey join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey
          where l_quantity >= 49 and l_discount = 0 and l_returnflag = 'R'),
        ways as (select giver, taker from edges union select w.giver, e.taker from ways w join edges e on w.taker = e.giver)
        select giver, taker from ways""",
    "part_distances": """
        with recursive edges as (select distinct a.l_partkey as a, b.l_partkey as b from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1),
        ways as (select min(l_partkey) as node, 0 as level from lineitem union select b, level + 1 from ways join edges on node = a where level < 9)
        select node, min(level)::int as level from ways group by node""",
    "order_bursts": """
        with recursive o as (select o_orderkey, o_totalprice, case when o_orderdate::date - lag(o_orderdate::date) over w <= 60 then lag(o_orderkey) over w end as parent
          from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
        h as (select o_orderkey, o_orderkey as first_order, 0 as level, o_totalprice as total from o where parent is null
          union all select o.o_orderkey, first_order, level + 1, total + o_totalprice from h join o on o.parent = h.o_orderkey)
        select o_orderkey, first_order, level, round(total, 2) as total from h""",
    "pattern_repeated": _islands("user_id", "signup", "'error'", 1, ""),
    "pattern_alternatives": _islands("", "purchase", "'view', 'error'", 1, "click"),
    "pattern_gap": _islands("user_id", "purchase", "'click', 'error', 'view'", 0, "signup").replace("and lag_kind", "and len <= 3 and lag_kind"),
    "asof_next_purchase": """
        with s as (select event_id, user_id, ts from events where event_type = 'signup'), p as (select user_id, ts, event_id, value from events where event_type = 'purchase')
        select s.event_id, s.user_id, s.ts, case when p.ts <= s.ts + interval 5 day then p.event_id end as other_id, case when p.ts <= s.ts + interval 5 day then p.value end as other_value
        from s asof left join p on s.user_id = p.user_id and s.ts <= p.ts""",
    "asof_nearest_error": """
        with c as (select event_id, user_id, ts from events where event_type = 'click'), r as (select ts, event_id, value from events where event_type = 'error'),
        b as (select c.*, r.ts as bt, r.event_id as bi, r.value as bv from c asof left join r on c.ts >= r.ts), f as (select c.event_id, r.ts as ft, r.event_id as fi, r.value as fv from c asof left join r on c.ts <= r.ts)
        select event_id, user_id, ts, case when ft is null or ts - bt <= ft - ts then bi else fi end as other_id, case when ft is null or ts - bt <= ft - ts then bv else fv end as other_value from b join f using (event_id)""",
    "asof_last_view": """
        with p as (select event_id, user_id, ts from events where event_type = 'purchase'), v as (select ts, event_id, value from events where event_type = 'view')
        select p.event_id, p.user_id, p.ts, case when p.ts - v.ts <= interval 10 minute then v.event_id end as other_id, case when p.ts - v.ts <= interval 10 minute then v.value end as other_value
        from p asof left join v on p.ts > v.ts""",
    "overlapping_shipments": """
        with l as (select *, l_shipdate::date - date '1970-01-01' as day, l_shipdate::date - date '1970-01-01' + case when l_linenumber = 1 then 730 else l_quantity::int end as last from lineitem)
        select a.l_partkey, count(*) as pairs, sum(least(a.last, n.last) - greatest(a.day, n.day) + 1)::bigint as days, sum(a.l_orderkey - n.l_orderkey)::bigint as apart
        from l a join l n on a.l_partkey = n.l_partkey and a.l_returnflag = 'A' and n.l_returnflag = 'N' and a.day <= n.last and n.day <= a.last group by 1""",
    "within_group": """
        select l_returnflag, cast(percentile_cont(0.25) within group (order by l_quantity) as double) as q1, cast(percentile_disc(0.5) within group (order by l_extendedprice) as double) as m
        from lineitem group by l_returnflag""",
    "medians": "select l_linenumber, median(l_quantity) as med, count(*) as n from lineitem group by l_linenumber",
    "approximate_percentiles": "select l_returnflag, true as mid, true as high from lineitem group by l_returnflag",
    "percentiles": "select l_returnflag, quantile_cont(l_quantity, 0.9) as p90 from lineitem group by l_returnflag",
    "frames_excluding": _excluding(),
}
