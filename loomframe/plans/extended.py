"""Queries with table functions, mergeable aggregates, variants and bucketed tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe import functions as L
from loomframe.sources import read_table, register_views, write_bucketed
from loomframe.sources.stages import stage


def thinned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events that are eight hours or more after the last one that was kept."""
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return L.thinned(events, "user_id", "ts", "event_id", 8 * 3600)


def vector_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the embeddings of a label scatter."""
    found = L.aggregated(read_table(spark, sf_dir, "embeddings").select("label", "embedding"), "label", "embedding", L.Spread(64))
    return found.select("label", "n", F.round("variance", 6).alias("variance"), F.round("dimension", 4).alias("dimension"))


#: An event as nested JSON whose shape differs by type: a struct in a struct, a list, a number that is a text elsewhere.
_DOC = """'{"props":' || props || ',"by":{"user":' || cast(user_id as string) || ',"kind":"' || event_type || '"}' ||
  case event_type when 'error' then ',"codes":[' || cast(event_id % 7 as string) || ',' || cast(event_id % 5 as string) || ']' when 'click' then ',"note":' || cast(event_id % 3 as string)
  when 'view' then ',"note":"n' || cast(event_id % 3 as string) || '"' else '' end || '}'"""


def variant_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields by path; those that are missing or of another kind are null."""
    register_views(spark, sf_dir, ("events",))
    return spark.sql(f"""
        with v as (select event_id, parse_json({_DOC}) as doc from events)
        select event_id, variant_get(doc, '$.props.k', 'string') as k, variant_get(doc, '$.by.user', 'bigint') as user, try_variant_get(doc, '$.codes[1]', 'int') as code, try_variant_get(doc, '$.note', 'int') as note,
          is_variant_null(variant_get(doc, '$.nothing')) as nothing from v""")


def variant_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each field of each document, and one for each element of its list."""
    register_views(spark, sf_dir, ("events",))
    return spark.sql(f"""
        with v as (select event_id, parse_json({_DOC}) as doc from events)
        select event_id, key, to_json(value) as value from v, lateral variant_explode(doc) as t(pos, key, value)
        union all select event_id, 'codes[' || pos || ']', cast(value as string) from v, lateral variant_explode(variant_get(doc, '$.codes')) as t(pos, key, value)""")


def variant_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema that the documents of each type have in common, and that of all: where kinds drift apart, a variant stays."""
    register_views(spark, sf_dir, ("events",))
    return spark.sql(f"""
        with v as (select event_type, parse_json({_DOC}) as doc from events)
        select event_type, regexp_count(schema_of_variant_agg(doc), 'ARRAY<BIGINT>') as lists, regexp_extract(schema_of_variant_agg(doc), 'note: ([A-Z]+)', 1) as note from v group by event_type
        union all select 'all', regexp_count(schema_of_variant_agg(doc), 'ARRAY<BIGINT>'), regexp_extract(schema_of_variant_agg(doc), 'note: ([A-Z]+)', 1) from v""")


def bucketed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables bucketed alike by their key: the join and the sums by that key shuffle nothing."""
    found, names = joined_buckets(spark, sf_dir)
    out = stage(found, "bucketed")
    for name in names:
        spark.sql(f"drop table {name}")
    return out


def joined_buckets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    names = [f"loomframe_{uuid.uuid4().hex}" for _ in range(2)]
    write_bucketed(read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("custkey"), "o_totalprice"), names[0], ("custkey",), 8)
    write_bucketed(read_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("custkey"), "c_name"), names[1], ("custkey",), 8)
    pairs = spark.table(names[0]).hint("merge").join(spark.table(names[1]), "custkey")
    return pairs.groupBy("custkey", "c_name").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top")), names


QUERIES = {f.__name__: f for f in (bucketed_join, thinned_events, vector_spread, variant_fields, variant_exploded, variant_shapes)}

SQL = {
    "bucketed_join": "select o_custkey as custkey, c_name, count(*) as n, max(o_totalprice) as top from orders join customer on c_custkey = o_custkey group by 1, 2",
    "thinned_events": """
        with recursive e as (select event_id, user_id, ts, row_number() over (partition by user_id order by ts, event_id) as p from events),
        k as (select event_id, user_id, ts, p, 1::bigint as kept_no from e where p = 1
          union all select n.event_id, n.user_id, n.ts, n.p, k.kept_no + 1 from k join lateral (select * from e where e.user_id = k.user_id and e.p > k.p and e.ts >= k.ts + interval 8 hour order by p limit 1) n on true)
        select event_id, user_id, ts, kept_no from k""",
    "vector_spread": """
        with x as (select label, vec_id, i, embedding[i]::double as v from embeddings, range(1, 65) as r(i)),
        c as (select a.label, a.i, b.i as j, covar_samp(a.v, b.v) as c from x a join x b on a.vec_id = b.vec_id group by all)
        select label, n, round(sum(c) filter (i = j), 6) as variance, round((sum(c) filter (i = j)) ** 2 / sum(c * c), 4) as dimension from c join (select label, count(*) as n from embeddings group by 1) using (label) group by label, n""",
    "variant_fields": """
        select event_id, json_extract_string(props, '$.k') as k, user_id as user, case event_type when 'error' then (event_id % 5)::int end as code,
          case event_type when 'click' then (event_id % 3)::int end as note, false as nothing from events""",
    "variant_exploded": """
        with d as (select event_id, event_type, user_id, json(props)::varchar as p from events)
        select event_id, 'props' as key, p as value from d union all select event_id, 'by', '{"kind":"' || event_type || '","user":' || user_id || '}' from d
        union all select event_id, 'codes', '[' || event_id % 7 || ',' || event_id % 5 || ']' from d where event_type = 'error'
        union all select event_id, 'note', case event_type when 'click' then (event_id % 3)::varchar else '"n' || event_id % 3 || '"' end from d where event_type in ('click', 'view')
        union all select event_id, 'codes[0]', (event_id % 7)::varchar from d where event_type = 'error' union all select event_id, 'codes[1]', (event_id % 5)::varchar from d where event_type = 'error'""",
    "variant_shapes": """
        select distinct event_type, (event_type = 'error')::int as lists, case event_type when 'click' then 'BIGINT' when 'view' then 'STRING' else '' end as note from events union all select 'all', 1, 'VARIANT'""",
}
