"""Aggregates, sketches, windows and join forms, as (tables, SQL) or (tables, Spark SQL, DuckDB SQL)."""

from __future__ import annotations

#: Orders with nulls in them, as the given tables have none.
HOLED = "(select o_orderkey, o_custkey, nullif(o_orderstatus, 'P') as status, case when o_orderkey % 7 <> 0 then o_totalprice end as price, o_orderpriority, o_orderdate from orders) h"

SHARED: dict[str, tuple[tuple[str, ...], str]] = {
    "string_extremes": (("part",), "select p_brand, min(p_name) as lo, max(p_name) as hi, min(p_type) as t from part group by p_brand"),
    # what depends on the key, so that any row of a group gives the same
    "any_of_group": (("orders", "customer"), """
        select o_custkey, any_value(c_name) as c, first(c_nationkey) as f, last(c_mktsegment) as l, count(*) as n from orders join customer on c_custkey = o_custkey group by o_custkey"""),
    "group_by_all": (("orders",), "select o_orderstatus, o_orderpriority, count(*) as n, max(o_totalprice) as top from orders group by all"),
    "population": (("lineitem",), """
        select l_linenumber, round(covar_pop(l_quantity, l_extendedprice), 3) as cp, round(stddev_pop(l_tax), 9) as sp, round(var_samp(l_discount), 9) as vs from lineitem group by l_linenumber"""),
    "regressions": (("lineitem",), """
        select l_returnflag, regr_count(l_extendedprice, l_quantity) as n, round(regr_slope(l_extendedprice, l_quantity), 5) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as cut,
          round(regr_r2(l_extendedprice, l_quantity), 9) as r2, round(regr_avgx(l_extendedprice, l_quantity), 6) as ax, round(regr_avgy(l_extendedprice, l_quantity), 4) as ay,
          round(regr_sxy(l_extendedprice, l_quantity) / 1000, 2) as sxy from lineitem group by l_returnflag"""),
    "bits_and_bools": (("part",), """
        select p_type, bit_and(p_size) as a, bit_or(p_size) as o, bit_xor(p_size) as x, bool_and(p_size > 0) as every_one, bool_or(p_size > 49) as some from part group by p_type"""),
    "null_counts": (("orders",), f"""
        select o_orderpriority, count(*) as n, count(price) as priced, count(distinct status) as states, sum(price) is null as none, avg(price) > 0 as positive,
          count(case when status is null then 1 end) as unknown from {HOLED} group by o_orderpriority"""),
    "right_join": (("supplier", "nation"), """
        select n_name, count(s_suppkey) as n from supplier right join nation on s_nationkey = n_nationkey and s_acctbal > 5000 group by n_name"""),
    "cross_join": (("region", "nation"), "select a.r_name as region, b.n_name as nation from region a cross join nation b"),
    "using_join": (("nation",), "select n_regionkey, a.n_name as one, b.n_name as other from nation a join (select n_regionkey, n_name from nation) b using (n_regionkey)"),
    "null_safe_join": (("orders",), f"""
        select count(*) as n from (select distinct status from {HOLED}) a join (select distinct status from {HOLED}) b on a.status is not distinct from b.status"""),
    "exists_or": (("customer", "orders"), """
        select c_custkey from customer where c_acctbal > 9000 or exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT' and o_totalprice > 400000)"""),
    "nested_ctes": (("orders", "customer"), """
        with m as (select o_custkey, max(o_totalprice) as top from orders group by o_custkey), r as (select o_custkey, c_nationkey, top, rank() over (partition by c_nationkey order by top desc, o_custkey) as place
          from m join customer on c_custkey = o_custkey)
        select o_custkey, c_nationkey, top, place from r where place <= 5"""),
    "nth_values": (("events",), """
        select event_id, nth_value(event_type, 2) over w as second, nth_value(value, 3) over w as third
        from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following)"""),
    "window_ends": (("events",), """
        select event_id, sum(value) over (partition by user_id order by ts, event_id rows between 1 following and 3 following) as coming,
          min(value) over (partition by user_id order by ts, event_id rows between 3 preceding and 1 preceding) as gone,
          count(*) over (partition by user_id, event_type) as n from events"""),
    "empty_groups": (("orders",), "select count(*) as n, sum(o_totalprice) as s, max(o_orderstatus) as m from orders where o_totalprice < 0"),
    "ordered_by_nulls": (("orders",), f"""
        select o_orderkey, row_number() over (partition by o_custkey order by price desc nulls last, o_orderkey) as r from {HOLED}"""),
}

PAIRED: dict[str, tuple[tuple[str, ...], str, str]] = {
    "ignore_nulls": (("orders",),
        f"select o_orderkey, last_value(price) ignore nulls over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding) as before from {HOLED}",
        f"select o_orderkey, last_value(price ignore nulls) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding) as before from {HOLED}"),
    "skewness_kurtosis": (("lineitem",),
        "select l_linenumber, round(skewness(l_extendedprice), 6) as s, round(kurtosis(l_extendedprice), 6) as k from lineitem group by l_linenumber",
        """with m as (select l_linenumber as g, avg(l_extendedprice) as a from lineitem group by 1),
        d as (select l_linenumber, avg((l_extendedprice - a) ** 2) as m2, avg((l_extendedprice - a) ** 3) as m3, avg((l_extendedprice - a) ** 4) as m4 from lineitem join m on g = l_linenumber group by 1)
        select l_linenumber, round(m3 / m2 ** 1.5, 6) as s, round(m4 / m2 ** 2 - 3, 6) as k from d"""),
    "modes": (("part",),
        "select p_brand, mode() within group (order by p_type) as m, mode() within group (order by p_size desc) as s from part group by p_brand",
        """with t as (select p_brand, p_type, count(*) as n from part group by all), s as (select p_brand, p_size, count(*) as n from part group by all)
        select p_brand, (select p_type from t where t.p_brand = b.p_brand order by n desc, p_type limit 1) as m, (select p_size from s where s.p_brand = b.p_brand order by n desc, p_size desc limit 1) as s
        from (select distinct p_brand from part) b"""),
    "string_aggregates": (("nation",),
        "select n_regionkey, listagg(n_name, ', ') within group (order by n_name) as names, string_agg(distinct substr(n_name, 1, 1), '') within group (order by substr(n_name, 1, 1)) as heads from nation group by n_regionkey",
        "select n_regionkey, string_agg(n_name, ', ' order by n_name) as names, string_agg(distinct substr(n_name, 1, 1), '' order by substr(n_name, 1, 1)) as heads from nation group by n_regionkey"),
    "counted_if": (("lineitem",),
        "select l_linestatus, count_if(l_quantity > 25) as big, try_sum(l_linenumber) as s, try_avg(l_linenumber) as a from lineitem group by l_linestatus",
        "select l_linestatus, count_if(l_quantity > 25)::bigint as big, sum(l_linenumber)::bigint as s, avg(l_linenumber) as a from lineitem group by l_linestatus"),
    "every_some": (("orders",),
        "select o_orderpriority, every(o_totalprice > 0) as e, some(o_orderstatus = 'P') as s, array_join(array_sort(collect_set(o_orderstatus)), ',') as states from orders group by o_orderpriority",
        "select o_orderpriority, bool_and(o_totalprice > 0) as e, bool_or(o_orderstatus = 'P') as s, array_to_string(list_sort(list(distinct o_orderstatus)), ',') as states from orders group by o_orderpriority"),
    # sketches: whether the estimate is within their stated error, which both engines must agree is so
    "approximate_counts": (("lineitem",),
        "select l_returnflag, abs(approx_count_distinct(l_partkey, 0.02) - count(distinct l_partkey)) <= 0.1 * count(distinct l_partkey) as near from lineitem group by l_returnflag",
        "select l_returnflag, true as near from lineitem group by l_returnflag"),
    "hll_sketches": (("lineitem",),
        """with s as (select l_returnflag, l_linestatus, hll_sketch_agg(l_partkey, 14) as k from lineitem group by l_returnflag, l_linestatus),
        u as (select l_returnflag, hll_sketch_estimate(hll_union_agg(k)) as e from s group by l_returnflag), d as (select l_returnflag as g, count(distinct l_partkey) as n from lineitem group by l_returnflag)
        select l_returnflag, abs(e - n) <= 0.05 * n as near from u join d on g = l_returnflag""",
        "select l_returnflag, true as near from lineitem group by l_returnflag"),
    "theta_sketches": (("orders",),
        """with a as (select theta_sketch_agg(o_custkey) as s from orders where o_orderstatus = 'F'), b as (select theta_sketch_agg(o_custkey) as s from orders where o_orderstatus = 'O'),
        t as (select count(*) as n from (select o_custkey from orders where o_orderstatus = 'F' intersect select o_custkey from orders where o_orderstatus = 'O'))
        select abs(theta_sketch_estimate(theta_intersection(a.s, b.s)) - n) <= 0.1 * n as near from a cross join b cross join t""",
        "select true as near"),
    "kll_sketches": (("lineitem",),
        # between the percentiles 0.45 and 0.55, by the places of the rows about the estimate: no task gets the values
        """with k as (select kll_sketch_get_quantile_double(kll_sketch_agg_double(l_extendedprice), 0.5) as q from lineitem),
        r as (select any_value(q) as q, count(l_extendedprice) as n, count_if(l_extendedprice <= q) as upto, count_if(l_extendedprice < q) as below from lineitem cross join k)
        select case when q is not null then upto > ceil(0.45D * (n - 1)) and below <= floor(0.55D * (n - 1)) end as near from r""",
        "select true as near"),
    "count_min": (("events",),
        # a sketch's bytes: version, total, depth, width, hashes, and a row of counters for each hash; each row holds every item once
        """with k as (select event_type, count_min_sketch(user_id, 0.05D, 0.9D, 7) as s from events group by event_type),
        d as (select event_type, s, cast(conv(hex(substr(s, 5, 8)), 16, 10) as bigint) as total, cast(conv(hex(substr(s, 13, 4)), 16, 10) as int) as depth, cast(conv(hex(substr(s, 17, 4)), 16, 10) as int) as width from k)
        select event_type, total, aggregate(sequence(0, depth - 1), true, (ok, r) -> ok and aggregate(sequence(0, width - 1), 0L, (t, c) -> t + cast(conv(hex(substr(s, 21 + 8 * depth + 8 * (r * width + c), 8)), 16, 10) as bigint)) = total) as full from d""",
        "select event_type, count(*) as total, true as full from events group by event_type"),
    "bitmap_counts": (("lineitem",),
        """select sum(n) as n from (select bitmap_bucket_number(l_partkey) as b, bitmap_count(bitmap_construct_agg(bitmap_bit_position(l_partkey))) as n from lineitem group by bitmap_bucket_number(l_partkey))""",
        "select count(distinct l_partkey)::bigint as n from lineitem"),
    "histograms": (("lineitem",),
        "select l_returnflag, size(histogram_numeric(l_quantity, 10)) as bins, cast(aggregate(histogram_numeric(l_quantity, 10), 0D, (s, x) -> s + x.y) as bigint) as n from lineitem group by l_returnflag",
        "select l_returnflag, 10 as bins, count(*) as n from lineitem group by l_returnflag"),
    "top_k_sketch": (("events",),
        # fewer kinds than the sketch has places, so its counts are exact
        "select t[0].item as item, array_join(transform(t, x -> cast(x.count as string)), ',') as counts from (select approx_top_k(event_type, 3) as t from events)",
        """with c as (select event_type, count(*) as n from events group by 1 order by n desc limit 3)
        select max_by(event_type, n) as item, string_agg(n::varchar, ',' order by n desc) as counts from c"""),
    "join_hints": (("orders", "customer"),
        """select m.c_nationkey, m.n, s.top from (select /*+ MERGE(c) */ c_nationkey, count(*) as n from orders join customer c on o_custkey = c_custkey group by c_nationkey) m
        join (select /*+ SHUFFLE_HASH(c) */ c_nationkey, max(o_totalprice) as top from orders join customer c on o_custkey = c_custkey group by c_nationkey) s on m.c_nationkey = s.c_nationkey""",
        "select c_nationkey, count(*) as n, max(o_totalprice) as top from orders join customer on o_custkey = c_custkey group by c_nationkey"),
    "pipe_syntax": (("orders",),
        "from orders |> where o_orderstatus = 'O' |> extend o_totalprice * 2 as twice |> aggregate count(*) as n, max(twice) as top group by o_orderpriority |> order by o_orderpriority |> limit 3",
        "select o_orderpriority, count(*) as n, max(o_totalprice * 2) as top from orders where o_orderstatus = 'O' group by 1 order by 1 limit 3"),
    "lateral_aliases": (("part",),
        "select p_partkey, p_size * 2 as twice, twice + 1 as more from part",
        "select p_partkey, p_size * 2 as twice, p_size * 2 + 1 as more from part"),
    "exclude_current": (("events",),
        # EXCLUDE CURRENT ROW: the frame's sum and count without the row's own
        """select event_id, (count(*) over w) - 1 as n, round((sum(value) over w) - value, 6) as s
        from events window w as (partition by user_id order by ts, event_id rows between 2 preceding and 2 following)""",
        """select event_id, count(*) over w as n, round(coalesce(sum(value) over w, 0), 6) as s
        from events window w as (partition by user_id order by ts, event_id rows between 2 preceding and 2 following exclude current row)"""),
    "row_pattern": (("events",),
        # a run of two or more errors and then a signup, by flags of neighbours
        """select user_id, count(*) as n from (select user_id, event_type, lag(event_type, 1) over w as a, lag(event_type, 2) over w as b from events window w as (partition by user_id order by ts, event_id))
        where event_type = 'signup' and a = 'error' and b = 'error' group by user_id""",
        """with s as (select user_id, string_agg(case event_type when 'error' then 'e' when 'signup' then 's' else 'x' end, '' order by ts, event_id) as path from events group by 1)
        select user_id, len(regexp_extract_all(path, 'ees'))::bigint as n from s where regexp_matches(path, 'ees')"""),
}
