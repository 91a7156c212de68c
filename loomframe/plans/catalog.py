"""Registered relational, event-time and streaming queries and their DuckDB twins.

SHARED texts run unchanged on both engines, PAIRED ones have one for each; the rest use the operators of
this package and DataFrame methods.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomframe.plans import aggregates, built, extended, frames, ordered, replayed, scalars
from loomframe.sources import TABLES, register_views

#: name -> (tables, SQL for both engines)
SHARED: dict[str, tuple[tuple[str, ...], str]] = {
    # scans, filters, projections
    "q6_filter_sum": (("lineitem",), """
        select round(sum(l_extendedprice * l_discount), 4) as rev from lineitem
        where l_discount between 0.05 and 0.07 and l_quantity < 24"""),
    "filter_predicates": (("part",), """
        select p_partkey, p_name, coalesce(nullif(p_brand, 'Brand#11'), 'none') as brand,
          case when p_size < 10 then 'small' when p_size < 30 then 'middle' else 'large' end as kind
        from part where (p_name like '%a%' or p_type not in ('PROMO', 'ECONOMY')) and p_size between 5 and 45 and p_retailprice is not null"""),
    "in_and_not_in": (("orders",), """
        select o_orderkey, o_orderstatus in ('O', null) as maybe from orders where o_orderpriority not in ('1-URGENT', '2-HIGH')"""),
    "distinct_rows": (("lineitem",), "select distinct l_returnflag, l_linestatus, l_linenumber from lineitem"),
    "top_orders": (("orders",), "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25"),
    "offset_page": (("orders",), "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10 offset 40"),
    # joins
    "q3_three_way_join": (("customer", "orders", "lineitem"), """
        select o_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) as rev, o_orderdate
        from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey
        where c_mktsegment = 'BUILDING' and o_orderdate < timestamp '1998-03-15 00:00:00' group by o_orderkey, o_orderdate"""),
    "five_way_region_rev": (("lineitem", "orders", "customer", "nation", "region"), """
        select n_name, round(sum(l_extendedprice * (1 - l_discount)), 3) as rev
        from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
          join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
        where r_name = 'ASIA' group by n_name"""),
    "semi_join": (("customer", "orders"), """
        select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)"""),
    "anti_join": (("orders", "lineitem"), """
        select o_orderkey, o_custkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)"""),
    "left_join": (("orders", "lineitem"), """
        select o_orderkey, count(l_linenumber) as n_lines, coalesce(sum(l_quantity), 0) as quantity
        from orders left join lineitem on l_orderkey = o_orderkey and l_returnflag = 'R' group by o_orderkey"""),
    "full_join": (("supplier", "customer"), """
        select coalesce(s.k, c.k) as nation, s.n as suppliers, c.n as customers
        from (select s_nationkey as k, count(*) as n from supplier where s_acctbal > 3000 group by s_nationkey) s
        full join (select c_nationkey as k, count(*) as n from customer where c_acctbal < 0 group by c_nationkey) c on s.k = c.k"""),
    "theta_join": (("nation", "region"), """
        select n_name, r_name from nation join region on n_regionkey < r_regionkey and length(n_name) > length(r_name)"""),
    "self_join": (("nation",), """
        select a.n_name as first, b.n_name as second from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey"""),
    "correlated_avg": (("orders",), """
        select count(*) as n from orders o where o_totalprice > (select avg(o2.o_totalprice) from orders o2 where o2.o_custkey = o.o_custkey)"""),
    "scalar_subquery": (("part",), "select p_partkey from part where p_retailprice > (select avg(p_retailprice) from part)"),
    "lateral_top": (("customer", "orders"), """
        select c_custkey, t.o_orderkey, t.o_totalprice from customer,
          lateral (select o_orderkey, o_totalprice from orders where o_custkey = c_custkey order by o_totalprice desc, o_orderkey limit 1) t"""),
    "recursive_steps": (("nation",), """
        with recursive linked as (select n_nationkey, n_regionkey, n_name, lag(n_nationkey) over (partition by n_regionkey order by n_nationkey) as before from nation),
        steps(k, depth, path) as (select n_nationkey, 1, cast(n_name as varchar(1000)) from linked where before is null
          union all select n_nationkey, depth + 1, cast(path || ' > ' || n_name as varchar(1000)) from steps join linked on before = k)
        select k, depth, path from steps"""),
    # aggregation
    "q1_pricing_summary": (("lineitem",), """
        select l_returnflag, l_linestatus, sum(l_quantity) as sq, round(sum(l_extendedprice), 2) as sp,
          round(sum(l_extendedprice * (1 - l_discount)), 3) as sd, round(avg(l_discount), 8) as ad, count(*) as n
        from lineitem where l_shipdate <= timestamp '2001-09-01 00:00:00' group by l_returnflag, l_linestatus"""),
    "count_distinct": (("lineitem",), "select l_returnflag, count(distinct l_partkey) as n from lineitem group by l_returnflag"),
    "several_distincts": (("lineitem",), """
        select l_linestatus, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers, count(*) as n from lineitem group by l_linestatus"""),
    "having": (("orders",), "select o_custkey, count(*) as n from orders group by o_custkey having count(*) > 12"),
    "filtered_aggregates": (("orders",), """
        select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as f, max(o_totalprice) filter (where o_orderstatus = 'O') as top
        from orders group by o_orderpriority"""),
    "rollup": (("lineitem",), """
        select l_returnflag, l_linestatus, sum(l_quantity) as q, grouping(l_returnflag) as ga, grouping(l_linestatus) as gb
        from lineitem group by rollup (l_returnflag, l_linestatus)"""),
    "cube": (("part",), "select p_brand, p_type, count(*) as n, max(p_size) as top from part group by cube (p_brand, p_type)"),
    "grouping_sets": (("orders",), """
        select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())"""),
    "spread": (("lineitem",), """
        select l_returnflag, round(stddev_samp(l_quantity), 6) as sd, round(var_pop(l_quantity), 6) as vp, round(corr(l_quantity, l_extendedprice), 6) as r,
          round(covar_samp(l_quantity, l_discount), 6) as c from lineitem group by l_returnflag"""),
    "extremes_by": (("orders",), """
        select o_custkey, max_by(o_orderkey, o_totalprice) as top_order, min_by(o_orderkey, o_totalprice) as least_order, bool_or(o_orderstatus = 'P') as pending
        from orders group by o_custkey"""),
    # windows
    "topk_per_customer": (("orders",), """
        select o_custkey, o_orderkey, r from (select o_custkey, o_orderkey, row_number() over (
          partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) x where r <= 3"""),
    "moving_avg": (("events",), """
        select event_id, round(avg(value) over (partition by user_id order by ts, event_id rows between 9 preceding and current row), 6) as m from events"""),
    "neighbours": (("events",), """
        select event_id, lag(event_type) over w as before, lead(value, 2) over w as later, first_value(event_id) over w as opened,
          last_value(event_id) over (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following) as closed
        from events window w as (partition by user_id order by ts, event_id)"""),
    "running_share": (("orders",), """
        select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding), 2) as running,
          count(*) over (partition by o_custkey) as n from orders"""),
    "range_frame": (("events",), """
        select event_id, count(*) over (partition by user_id order by ts range between interval '6' hour preceding and current row) as n from events"""),
    # set operations
    "union_all": (("customer", "supplier"), "select c_nationkey as k, 'c' as kind from customer union all select s_nationkey, 's' from supplier"),
    "union_distinct": (("customer", "supplier"), "select c_nationkey as k from customer union select s_nationkey from supplier"),
    "intersect": (("orders", "lineitem"), "select o_orderkey as k from orders where o_orderstatus = 'F' intersect select l_orderkey from lineitem where l_returnflag = 'R'"),
    "except": (("orders", "lineitem"), "select o_orderkey as k from orders except select l_orderkey from lineitem where l_quantity > 25"),
    "intersect_all": (("orders", "customer"), "select o_custkey as k from orders intersect all select o_custkey from orders where o_orderstatus = 'O'"),
    "except_all": (("orders",), "select o_custkey as k from orders except all select o_custkey from orders where o_orderstatus = 'O'"),
    # scalar functions
    "string_functions": (("part",), """
        select p_partkey, upper(p_name) as up, length(p_name) as n, substr(p_name, 2, 3) as mid, replace(p_name, 'e', '3') as leet, lpad(p_brand, 12, '*') as padded,
          trim('  x ') as trimmed, reverse(p_type) as rev, p_name || '/' || p_brand as joined, left(p_name, 2) as head, strpos_like as place
        from (select *, position('a' in p_name) as strpos_like from part) t"""),
    "date_functions": (("orders",), """
        select o_orderkey, cast(year(o_orderdate) as int) as y, cast(month(o_orderdate) as int) as m, cast(day(o_orderdate) as int) as d, cast(quarter(o_orderdate) as int) as q,
          cast(cast(date_trunc('month', o_orderdate) as date) as string) as first_day, cast(last_day(cast(o_orderdate as date)) as string) as last_day from orders"""),
    "math_functions": (("lineitem",), """
        select l_orderkey, l_linenumber, l_quantity, cast(floor(l_discount * 100 + 0.5) as bigint) as pct, abs(l_tax - l_discount) > 0.04 as far, round(sqrt(l_quantity), 9) as root,
          greatest(l_quantity, 25.0) as g, least(l_quantity, 25.0) as l, power(2, l_linenumber) as p, cast(sign(l_discount - 0.05) as int) as s from lineitem"""),
    "conditional_sums": (("lineitem",), """
        select l_shipdate, cast(sum(case when l_returnflag = 'R' then 1 else 0 end) as bigint) as returned, count(nullif(l_linestatus, 'O')) as not_open from lineitem group by l_shipdate"""),
}

#: name -> (tables, Spark SQL, DuckDB SQL) where the engines' words differ
PAIRED: dict[str, tuple[tuple[str, ...], str, str]] = {
    "json_fields": (("events",),
        "select event_id, get_json_object(props, '$.k') as k from events",
        "select event_id, json_extract_string(props, '$.k') as k from events"),
    "collected_lists": (("orders",),
        "select o_custkey, array_join(sort_array(collect_set(o_orderstatus)), ',') as states, size(collect_list(o_orderkey)) as n from orders group by o_custkey",
        "select o_custkey, array_to_string(list_sort(list(distinct o_orderstatus)), ',') as states, len(list(o_orderkey))::int as n from orders group by o_custkey"),
    "exploded_words": (("documents",),
        "select word, count(*) as n from (select explode(filter(split(lower(text), '[^a-z]+'), w -> w <> '')) as word from documents) t group by word",
        "select word, count(*) as n from (select unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '')) as word from documents) t group by word"),
    "pivot_status": (("orders",),
        "select * from (select o_orderpriority, o_orderstatus from orders) pivot (count(*) for o_orderstatus in ('F' as f, 'O' as o, 'P' as p))",
        "select o_orderpriority, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'O') as o, count(*) filter (o_orderstatus = 'P') as p from orders group by o_orderpriority"),
    "unpivot_prices": (("part",),
        "select p_partkey, field, amount from (select p_partkey, cast(p_size as double) as size, p_retailprice as price from part) unpivot (amount for field in (size, price))",
        "select p_partkey, 'size' as field, p_size::double as amount from part union all select p_partkey, 'price', p_retailprice from part"),
    "hashes": (("customer",),
        "select c_custkey, md5(c_name) as m, sha2(c_name, 256) as s from customer",
        "select c_custkey, md5(c_name) as m, sha256(c_name) as s from customer"),
    "regular_expressions": (("documents",),
        "select doc_id, regexp_replace(source, '[0-9]+', '#') as kind, regexp_extract(source, '([0-9]+)', 1) as num, size(split(text, '\\n')) as n_lines from documents",
        "select doc_id, regexp_replace(source, '[0-9]+', '#', 'g') as kind, regexp_extract(source, '([0-9]+)', 1) as num, len(string_split(text, chr(10)))::int as n_lines from documents"),
}


def _sql(tables: tuple[str, ...], text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_views(spark, sf_dir, tables)
        return spark.sql(text)

    return run


_SAME = SHARED | aggregates.SHARED | scalars.SHARED
_PAIRED = PAIRED | aggregates.PAIRED | scalars.PAIRED

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _sql(tables, text) for name, (tables, text) in _SAME.items()},
    **{name: _sql(tables, text) for name, (tables, text, _) in _PAIRED.items()},
    **frames.QUERIES,
    **built.QUERIES,
    **ordered.QUERIES,
    **extended.QUERIES,
    **replayed.QUERIES,
}
SQL: dict[str, str] = {**{n: t for n, (_, t) in _SAME.items()}, **{n: t for n, (_, _, t) in _PAIRED.items()}, **frames.SQL, **built.SQL, **ordered.SQL, **extended.SQL, **replayed.SQL}
assert {t for tables, *_ in [*_SAME.values(), *_PAIRED.values()] for t in tables} <= set(TABLES)
