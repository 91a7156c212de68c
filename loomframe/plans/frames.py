"""Queries by DataFrame methods and user-defined functions, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe import functions as L
from loomframe import operators as O
from loomframe.sources import number_rows, read_table


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with nulls in two columns, as the given tables have none."""
    orders = read_table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("price"))


def filled_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holed(spark, sf_dir).fillna({"status": "?", "price": -1.0})


def dropped_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holed(spark, sf_dir).dropna(how="any")


def dropped_mostly_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holed(spark, sf_dir).dropna(thresh=2)


def replaced_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return holed(spark, sf_dir).replace({"F": "done", "O": "open"}, subset=["status"]).select("o_orderkey", "status")


def first_of_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each key, of many; besides the key it has what depends on it, so that any of the rows gives the same."""
    customers = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return read_table(spark, sf_dir, "orders").select("o_custkey").join(customers, "o_custkey").dropDuplicates(["o_custkey"])


def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), "c_mktsegment")
    suppliers = read_table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").cast("long").alias("s_suppkey"))
    return customers.unionByName(suppliers, allowMissingColumns=True)


def transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read_table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_orderpriority").alias("kinds"))
    return counts.transpose("o_orderstatus").select("key", "F", "O", "P")


def sorted_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows dealt by customer and sorted in their partitions alone, as a writer wants them."""
    return read_table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey").repartition("o_custkey").sortWithinPartitions("o_custkey", "o_orderkey")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_orderkey").agg(F.round(F.product(1 + F.col("l_tax") / 10), 6).alias("p"))


def last_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What tail(5) of a sort gives, without bringing it to the driver: the first five of the reverse."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return orders.orderBy(F.col("o_totalprice").desc(), F.col("o_orderkey").desc()).limit(5)


def hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample that both engines can draw: orders whose key's digest begins with 0 to 3, a quarter of all."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey")
    return orders.where(F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 1) < "4")


def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bernoulli and by-stratum samples: their shares lie within five standard deviations."""
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    n = orders.agg(F.count(F.lit(1)).alias("n"))
    some = orders.sample(0.2, 7).agg(F.count(F.lit(1)).alias("k"))
    strata = orders.sampleBy("o_orderstatus", {"F": 1.0, "O": 0.0}, 7).agg(F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("f"), F.count(F.lit(1)).alias("all"))
    whole = orders.where("o_orderstatus = 'F'").agg(F.count(F.lit(1)).alias("whole"))
    near = F.abs(F.col("k") - 0.2 * F.col("n")) <= 5 * F.sqrt(0.16 * F.col("n"))
    # Each side is an aggregate of one row.
    return n.join(some).join(strata).join(whole).select(near.alias("near"), (F.col("f") == F.col("whole")).alias("all_f"), (F.col("all") == F.col("f")).alias("only_f"))


def renamed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "nation").withColumnRenamed("n_name", "nation").withColumns({"upper": F.upper("nation"), "twice": F.col("n_nationkey") * 2})
    return rows.drop("n_regionkey").selectExpr("n_nationkey as k", "upper", "twice", "length(nation) as n")


def melted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), "s_acctbal")
    return rows.melt(["s_suppkey"], ["nation", "s_acctbal"], "field", "amount")


def numbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part keys from the first to the last one by the data source of numbers, in four partitions, with the lines that have them."""
    lines = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("n")).agg(F.count(F.lit(1)).alias("lines"))
    ends = lines.agg(F.min("n"), F.max("n")).first()
    return number_rows(spark, ends[0], ends[1], 4).join(lines, "n", "left").select("n", F.coalesce("lines", F.lit(0)).alias("lines"))


def null_aware_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read_table(spark, sf_dir, "lineitem").where("l_quantity > 49").select("l_partkey")
    return O.not_in(read_table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", lines, "l_partkey")


def not_in_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOT IN without a broadcast of the list, for a list with and one without a null."""
    parts = read_table(spark, sf_dir, "part").select("p_partkey")
    lines = read_table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_partkey", F.when(F.col("l_partkey") % 50 != 0, F.col("l_partkey")).alias("holed"))
    return O.not_in(parts, "p_partkey", lines, "l_partkey").select("p_partkey", F.lit("plain").alias("kind")).unionByName(
        O.not_in(parts, "p_partkey", lines, "holed").select("p_partkey", F.lit("null").alias("kind")))


def asof_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An as-of join where keys and times are null on both sides: null matches nothing."""
    events = read_table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_id") % 11 != 0, F.col("user_id")).alias("user_id"), F.when(F.col("event_id") % 13 != 0, F.col("ts")).alias("ts"))
    clicks = events.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return O.asof_join(events.where("event_type = 'purchase'").drop("event_type"), clicks, "ts", ["user_id"], ["click_id"])


def large_lcm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least common multiples above 2^53, which doubles can't hold."""
    b = F.col("p_partkey") + F.lit(2**53)
    return read_table(spark, sf_dir, "part").select("p_partkey", L.lcm(F.lit(3).cast("long"), b * 3).alias("l"), L.gcd(b * 6, F.lit(4).cast("long")).alias("g"))


def normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar function in Arrow batches: Unicode normal form C of decomposed text."""
    bare = F.concat("text", F.lit("éä"))
    return read_table(spark, sf_dir, "benchmark").select("item_id", L.nfc(bare).alias("text"))


def ema_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in Python: the exponential moving average of each user's values, at the last one."""
    events = read_table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return L.moving_averages(events, "user_id", ["ts", "event_id"], "value", 0.3).select("user_id", F.round("ema", 6).alias("ema"))


def cogrouped_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables' groups in Python: each user's signups with the latest click before them."""
    events = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    left = events.where("event_type = 'signup'").select("user_id", "ts", "event_id")
    right = events.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return L.cogrouped_asof(left, right, "user_id", "ts", "click_id").select("event_id", "click_id")


def code_point_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar function over Arrow arrays."""
    bare = F.concat("text", F.lit("e\u0301"))
    return read_table(spark, sf_dir, "benchmark").select("item_id", L.code_points(bare).alias("n"))


def extracted_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions in pandas: a value found in each event's properties."""
    return L.extracted(read_table(spark, sf_dir, "events"), "event_id", "props", '"k": ?"?([^",}]*)', "k")


def batch_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions in Python: words of each text, by Arrow's own splitting."""
    return L.word_counts(read_table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (
    filled_nulls, dropped_nulls, dropped_mostly_null, replaced_values, first_of_keys, union_by_name, transposed, sorted_within, products, last_rows, hash_sample, random_sample, renamed_columns,
    melted, numbered_rows, null_aware_anti_join, not_in_operator, asof_with_nulls, large_lcm, normal_forms, code_point_counts, extracted_props, ema_last, cogrouped_asof, batch_word_counts,
)}

_HOLED = "(select o_orderkey, nullif(o_orderstatus, 'P') as status, case when o_orderkey % 7 <> 0 then o_totalprice end as price from orders)"
_EVENTS = "(select event_id, event_type, case when event_id % 11 <> 0 then user_id end as user_id, case when event_id % 13 <> 0 then ts end as ts from events)"

SQL = {
    "filled_nulls": f"select o_orderkey, coalesce(status, '?') as status, coalesce(price, -1.0) as price from {_HOLED}",
    "dropped_nulls": f"select * from {_HOLED} where status is not null and price is not null",
    "dropped_mostly_null": f"select * from {_HOLED} where status is not null or price is not null",
    "replaced_values": f"select o_orderkey, case status when 'F' then 'done' when 'O' then 'open' else status end as status from {_HOLED}",
    "first_of_keys": "select distinct o_custkey, c_name, c_mktsegment from orders join customer on o_custkey = c_custkey",
    "union_by_name": "select c_custkey, c_name as name, c_mktsegment, s_suppkey from customer, (select null::bigint as s_suppkey) union all select null, s_name, null, s_suppkey from supplier",
    "transposed": """with c as (select o_orderstatus as s, count(*) as n, count(distinct o_orderpriority) as kinds from orders group by 1)
        select 'n' as key, max(n) filter (s = 'F') as "F", max(n) filter (s = 'O') as "O", max(n) filter (s = 'P') as "P" from c
        union all select 'kinds', max(kinds) filter (s = 'F'), max(kinds) filter (s = 'O'), max(kinds) filter (s = 'P') from c""",
    "sorted_within": "select o_custkey, o_orderkey from orders",
    "products": "select l_orderkey, round(product(1 + l_tax / 10), 6) as p from lineitem group by 1",
    "last_rows": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey desc limit 5",
    "hash_sample": "select o_orderkey from orders where md5(o_orderkey::varchar)[1] < '4'",
    "random_sample": "select true as near, true as all_f, true as only_f",
    "renamed_columns": "select n_nationkey as k, upper(n_name) as upper, n_nationkey * 2 as twice, length(n_name)::int as n from nation",
    "melted": "select s_suppkey, 'nation' as field, s_nationkey::double as amount from supplier union all select s_suppkey, 's_acctbal', s_acctbal from supplier",
    "numbered_rows": """
        with l as (select l_partkey as n, count(*) as lines from lineitem group by 1)
        select n, coalesce(lines, 0) as lines from (select unnest(range((select min(n) from l), (select max(n) from l) + 1)) as n) left join l using (n)""",
    "null_aware_anti_join": "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 49)",
    "not_in_operator": """with l as (select l_partkey, case when l_partkey % 50 <> 0 then l_partkey end as holed from lineitem where l_quantity > 45)
        select p_partkey, 'plain' as kind from part where p_partkey not in (select l_partkey from l)
        union all select p_partkey, 'null' from part where p_partkey not in (select holed from l)""",
    "asof_with_nulls": f"""select p.event_id, p.user_id, p.ts, c.event_id as click_id from (select * from {_EVENTS} where event_type = 'purchase') p
        asof left join (select * from {_EVENTS} where event_type = 'click' and ts is not null) c on p.user_id = c.user_id and p.ts >= c.ts""",
    "large_lcm": "select p_partkey, lcm(3, (p_partkey + 9007199254740992) * 3)::bigint as l, gcd((p_partkey + 9007199254740992) * 6, 4)::bigint as g from part",
    "normal_forms": "select item_id, nfc_normalize(text || 'e' || chr(769) || 'a' || chr(776)) as text from benchmark",
    "code_point_counts": "select item_id, length(text || 'e' || chr(769))::bigint as n from benchmark",
    "extracted_props": "select event_id, json_extract_string(props, '$.k') as k from events",
    "ema_last": """select user_id, round(list_reduce(list(value order by ts, event_id), lambda a, x: 0.7 * a + 0.3 * x), 6) as ema from events group by 1""",
    "cogrouped_asof": """select s.event_id, c.event_id as click_id from (select * from events where event_type = 'signup') s
        asof left join (select * from events where event_type = 'click') c on s.user_id = c.user_id and s.ts >= c.ts""",
    "batch_word_counts": r"select doc_id, len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> ''))::bigint as n_words from documents",
}
