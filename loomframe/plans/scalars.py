"""Scalar functions and predicates, as (tables, SQL) or (tables, Spark SQL, DuckDB SQL)."""

from __future__ import annotations

SHARED: dict[str, tuple[tuple[str, ...], str]] = {
    "ilike_predicates": (("part",), "select p_partkey, p_name ilike '%A%' as any_a, p_type not ilike 'promo%' as no_promo, p_name like '%!%%' escape '!' as marked from part"),
    "text_cuts": (("customer",), """
        select c_custkey, right(c_name, 3) as tail, rpad(c_name, 20, '.') as padded, ltrim('  a ') as l, rtrim('  a ') as r, repeat('ab', 2) as twice, ascii(c_mktsegment) as code, chr(65) as letter,
          concat_ws('-', c_name, c_mktsegment) as joined, translate(c_mktsegment, 'AEI', 'aei') as some, split_part(c_name, '#', 2) as num, starts_with_c
        from (select *, c_name like 'C%' as starts_with_c from customer) t"""),
    "rounding": (("lineitem",), """
        select l_orderkey, l_linenumber, l_extendedprice, round(l_extendedprice) as r, ceil(l_extendedprice) as c, floor(l_extendedprice) as f, cast(l_quantity as bigint) % 7 as m, exp(l_tax) > 1.05 as e,
          round(ln(l_quantity), 9) as ln, round(log10(l_quantity), 9) as lg, round(log2(l_quantity), 9) as l2, round(cbrt(l_quantity), 9) as cb, round(degrees(l_tax), 9) as dg, round(radians(l_quantity), 9) as rd,
          round(sin(l_quantity), 9) as s, round(cos(l_quantity), 9) as co, round(tan(l_tax), 9) as t, round(atan2(l_tax, l_quantity), 9) as at, round(pi(), 9) as pi from lineitem"""),
    "inverse_trigonometry": (("lineitem",), """
        select l_orderkey, l_linenumber, l_tax, round(asin(l_tax), 9) as a, round(acos(l_tax), 9) as b, round(atan(l_quantity), 9) as c, round(sinh(l_tax), 9) as d, round(cosh(l_tax), 9) as e,
          round(tanh(l_tax), 9) as f, round(asinh(l_quantity), 9) as g, round(acosh(l_quantity), 9) as h, round(atanh(l_tax), 9) as i, round(cot(l_quantity), 9) as j from lineitem"""),
    "conditionals": (("orders",), """
        select o_orderkey, coalesce(nullif(o_orderstatus, 'P'), 'none') as s, nullif(o_orderkey % 3, 0) is null as third, o_orderstatus is distinct from 'F' as other, greatest(o_orderkey % 5, o_orderkey % 7) as g,
          least(o_orderkey % 5, 2) as l, case o_orderstatus when 'F' then 1 when 'O' then 2 else 3 end as code, ifnull(nullif(o_orderpriority, '5-LOW'), 'low') as p from orders"""),
    "casts": (("lineitem",), """
        select l_orderkey, l_linenumber, cast(l_linenumber as string) as s, cast(cast(l_discount as decimal(10, 4)) as double) as d, cast('12' as int) + l_linenumber as n, cast(cast(l_shipdate as date) as string) as day, cast(l_returnflag = 'R' as int) as flag,
          cast(l_linenumber as double) / 4 as q from lineitem"""),
    "date_parts": (("orders",), """
        select o_orderkey, cast(extract(year from o_orderdate) as int) as y, cast(extract(week from o_orderdate) as int) as w, cast(dayofyear(o_orderdate) as int) as dy, cast(extract(quarter from o_orderdate) as int) as q,
          o_orderdate + interval '1' day as tomorrow, o_orderdate - interval '2' hour as before, cast(hour(o_orderdate + interval '90' minute) as int) as h, cast(minute(o_orderdate + interval '90' minute) as int) as mi from orders"""),
    "bit_functions": (("part",), "select p_partkey, p_partkey & 12 as a, p_partkey | 5 as o, ~p_partkey as n, bit_count(p_partkey) as c from part"),
}

PAIRED: dict[str, tuple[tuple[str, ...], str, str]] = {
    "rlike_predicates": (("part",),
        "select p_partkey, p_name rlike '[aeiou]{2}' as vowels, regexp_count(p_name, '[aeiou]') as n, regexp_instr(p_name, 'e') as at, array_join(regexp_extract_all(p_name, '[a-z]e', 0), '|') as parts from part",
        "select p_partkey, regexp_matches(p_name, '[aeiou]{2}') as vowels, len(regexp_extract_all(p_name, '[aeiou]'))::int as n, position('e' in p_name)::int as at, array_to_string(regexp_extract_all(p_name, '[a-z]e'), '|') as parts from part"),
    "null_safe_equal": (("orders",),
        "select o_orderkey, nullif(o_orderstatus, 'P') <=> null as p, nullif(o_orderstatus, 'P') <=> 'F' as f from orders",
        "select o_orderkey, nullif(o_orderstatus, 'P') is not distinct from null as p, nullif(o_orderstatus, 'P') is not distinct from 'F' as f from orders"),
    "text_measures": (("customer",),
        "select c_custkey, levenshtein(c_name, 'Customer#0') as d, instr(c_name, '#') as i, locate('0', c_name, 11) as z, initcap(lower(c_mktsegment)) as cap, soundex('Robert') as sx, overlay(c_name placing '*' from 2 for 3) as o, btrim('xxaxx', 'x') as b from customer",
        "select c_custkey, levenshtein(c_name, 'Customer#0')::int as d, instr(c_name, '#')::int as i, (case when position('0' in c_name[11:]) > 0 then position('0' in c_name[11:]) + 10 else 0 end)::int as z, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) as cap, 'R163' as sx, c_name[1] || '*' || c_name[5:] as o, trim('xxaxx', 'x') as b from customer"),
    "encodings": (("customer",),
        "select c_custkey, base64(cast(c_name as binary)) as b, cast(unbase64(base64(cast(c_name as binary))) as string) as back, hex(c_name) as h, cast(unhex(hex(c_name)) as string) as unhexed, url_encode('a b&c') as u, url_decode('a+b%26c') as v, sha1(c_name) as s1 from customer",
        "select c_custkey, base64(c_name::blob) as b, c_name as back, hex(c_name) as h, c_name as unhexed, 'a+b%26c' as u, 'a b&c' as v, sha1(c_name) as s1 from customer"),
    "number_forms": (("part",),
        "select p_partkey, hex(p_partkey) as h, bin(p_partkey) as b, conv(cast(p_partkey as string), 10, 36) as c36, format_number(p_retailprice, 2) as f, lpad(cast(p_size as string), 4, '0') as z, factorial(p_size % 6) as fact, pmod(-p_size, 7) as pm, width_bucket(p_retailprice, 0, 2000, 10) as wb, positive(p_size) as pos, negative(p_size) as neg from part",
        """select p_partkey, to_hex(p_partkey) as h, bin(p_partkey) as b, upper(to_base(p_partkey, 36)) as c36, format('{:,.2f}', p_retailprice) as f, lpad(p_size::varchar, 4, '0') as z, factorial(p_size % 6)::bigint as fact, ((-p_size % 7) + 7) % 7 as pm,
          case when p_retailprice < 0 then 0 when p_retailprice >= 2000 then 11 else floor(p_retailprice / 200)::bigint + 1 end as wb, p_size as pos, -p_size as neg from part"""),
    "shifts": (("part",),
        "select p_partkey, shiftleft(p_partkey, 3) as l, shiftright(p_partkey, 2) as r, p_partkey ^ 5 as x, getbit(p_partkey, 1) as g, bit_get(p_partkey, 0) as z, shiftrightunsigned(p_partkey, 1) as u from part",
        "select p_partkey, p_partkey << 3 as l, p_partkey >> 2 as r, xor(p_partkey, 5) as x, ((p_partkey >> 1) & 1)::tinyint as g, (p_partkey & 1)::tinyint as z, p_partkey >> 1 as u from part"),
    "date_arithmetic": (("orders",),
        """select o_orderkey, cast(date_add(cast(o_orderdate as date), 10) as string) as later, cast(date_sub(cast(o_orderdate as date), 3) as string) as sooner, datediff(date'2002-01-01', cast(o_orderdate as date)) as days, cast(add_months(cast(o_orderdate as date), 2) as string) as months,
          cast(months_between(date'2002-01-01', trunc(cast(o_orderdate as date), 'MM')) as int) as between_, cast(next_day(cast(o_orderdate as date), 'MON') as string) as monday, dayofweek(o_orderdate) as dow, weekday(o_orderdate) as wd, date_format(o_orderdate, 'yyyy/MM/dd') as text,
          monthname(cast(o_orderdate as date)) as mn, dayname(cast(o_orderdate as date)) as dn, unix_date(cast(o_orderdate as date)) as ud from orders""",
        """select o_orderkey, (o_orderdate::date + 10)::string as later, (o_orderdate::date - 3)::string as sooner, date '2002-01-01' - o_orderdate::date as days, (o_orderdate::date + interval 2 month)::date::string as months,
          date_diff('month', date_trunc('month', o_orderdate)::date, date '2002-01-01')::int as between_, (o_orderdate::date + (8 - isodow(o_orderdate))::int)::date::string as monday, (dayofweek(o_orderdate) + 1)::int as dow, (isodow(o_orderdate) - 1)::int as wd, strftime(o_orderdate, '%Y/%m/%d') as text,
          left(monthname(o_orderdate), 3) as mn, left(dayname(o_orderdate), 3) as dn, (o_orderdate::date - date '1970-01-01')::int as ud from orders"""),
    "made_dates": (("orders",),
        """select o_orderkey, cast(make_date(year(o_orderdate), 1, 15) as string) as d, make_timestamp_ntz(2020, 2, 29, 1, 2, 3.5) as ts, cast(to_date(date_format(o_orderdate, 'dd.MM.yyyy'), 'dd.MM.yyyy') as string) as parsed, to_timestamp_ntz('2021-03-04 05:06:07') as t,
          cast(cast(date_trunc('quarter', o_orderdate) as date) as string) as q, timestampdiff(DAY, o_orderdate, timestamp_ntz'2002-01-01 00:00:00') as diff, timestampadd(HOUR, 5, o_orderdate) as plus, cast(last_day(make_date(2024, 2, 1)) as string) as leap from orders""",
        """select o_orderkey, make_date(year(o_orderdate), 1, 15)::string as d, make_timestamp(2020, 2, 29, 1, 2, 3.5) as ts, strptime(strftime(o_orderdate, '%d.%m.%Y'), '%d.%m.%Y')::date::string as parsed, timestamp '2021-03-04 05:06:07' as t,
          date_trunc('quarter', o_orderdate)::date::string as q, date_diff('day', o_orderdate, timestamp '2002-01-01') as diff, o_orderdate + interval 5 hour as plus, '2024-02-29' as leap from orders"""),
    "time_zones": (("events",),
        "select event_id, cast(convert_timezone('UTC', 'Asia/Tokyo', ts) as timestamp_ntz) as tokyo, unix_seconds(cast(ts as timestamp)) as s, unix_millis(cast(ts as timestamp)) as ms, cast(timestamp_seconds(86400) as timestamp_ntz) as day2 from events",
        "select event_id, ts + interval 9 hour as tokyo, epoch_us(ts) // 1000000 as s, epoch_us(ts) // 1000 as ms, timestamp '1970-01-02 00:00:00' as day2 from events"),
    "intervals": (("events",),
        "select event_id, ts + make_interval(0, 1, 0, 2, 3, 0, 0) as moved, extract(hour from (ts - timestamp_ntz'2024-01-01 00:00:00')) as h, cast(floor((unix_seconds(cast(ts as timestamp)) - unix_seconds(timestamp'2024-01-01 00:00:00')) / 3600) as bigint) as hours from events",
        "select event_id, ts + interval 1 month + interval 2 day + interval 3 hour as moved, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 3600000000 % 24 as h, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) // 3600000000 as hours from events"),
    # Lists are joined into text, so that both engines' drivers give the same values.
    "array_functions": (("orders",),
        """select o_custkey, array_max(a) as hi, array_min(a) as lo, array_contains(a, 1L) as one, array_position(a, element_at(a, -1)) as at, array_join(slice(a, 1, 2), ',') as two, array_join(array_distinct(concat(a, a)), ',') as d,
          array_join(array_union(a, array(0L)), ',') as u, array_join(array_except(a, slice(a, 1, 1)), ',') as e, array_join(array_intersect(a, slice(a, 2, 9)), ',') as i, arrays_overlap(a, slice(a, 1, 1)) as o, array_join(array_remove(a, a[0]), ',') as r,
          array_join(reverse(a), ',') as back, array_join(array_append(a, -1L), ',') as more, array_join(array_prepend(a, -1L), ',') as led, array_join(array_compact(array(1L, null, 2L)), ',') as c, flatten(array(a, a)) = concat(a, a) as same,
          array_join(array_repeat(7, 2), ',') as rep, array_join(sequence(1, 3), ',') as s, array_join(array_insert(array(1, 3), 2, 2), ',') as ins, cardinality(a) as n, array_size(a) as z
        from (select o_custkey, sort_array(collect_list(o_orderkey)) as a from orders group by o_custkey) t""",
        """select o_custkey, list_max(a) as hi, list_min(a) as lo, list_contains(a, 1) as one, list_position(a, a[-1])::bigint as at, array_to_string(a[1:2], ',') as two, array_to_string(a, ',') as d,
          array_to_string(case when list_contains(a, 0) then a else list_append(a, 0) end, ',') as u, array_to_string(a[2:], ',') as e, array_to_string(a[2:10], ',') as i, true as o, array_to_string(a[2:], ',') as r,
          array_to_string(list_reverse(a), ',') as back, array_to_string(list_append(a, -1), ',') as more, array_to_string(list_prepend(-1, a), ',') as led, '1,2' as c, true as same, '7,7' as rep, '1,2,3' as s, '1,2,3' as ins, len(a)::int as n, len(a)::int as z
        from (select o_custkey, list_sort(list(o_orderkey)) as a from orders group by o_custkey) t"""),
    "higher_order": (("orders",),
        """select o_custkey, array_join(transform(a, x -> x % 10), ',') as t, array_join(transform(a, (x, i) -> x + i), ',') as ti, array_join(filter(a, x -> x % 2 = 0), ',') as f, exists(a, x -> x > 900) as ex, forall(a, x -> x > 0) as fa,
          aggregate(a, 0L, (s, x) -> s + x) as s, array_join(zip_with(a, reverse(a), (x, y) -> x - y), ',') as z, array_join(array_sort(a, (x, y) -> case when x < y then 1 when x > y then -1 else 0 end), ',') as down, element_at(a, 1) as first,
          try_element_at(a, 99) is null as none, size(a) as n from (select o_custkey, sort_array(collect_list(o_orderkey)) as a from orders group by o_custkey) t""",
        """select o_custkey, array_to_string(list_transform(a, lambda x: x % 10), ',') as t, array_to_string(list_transform(a, lambda x, i: x + i - 1), ',') as ti, array_to_string(list_filter(a, lambda x: x % 2 = 0), ',') as f,
          len(list_filter(a, lambda x: x > 900)) > 0 as ex, len(list_filter(a, lambda x: x > 0)) = len(a) as fa, list_sum(a)::bigint as s, array_to_string(list_transform(a, lambda x, i: x - list_reverse(a)[i]), ',') as z,
          array_to_string(list_reverse(a), ',') as down, a[1] as first, a[99] is null as none, len(a)::int as n from (select o_custkey, list_sort(list(o_orderkey)) as a from orders group by o_custkey) t"""),
    "generators": (("orders",),
        """select o_custkey, pos, k, x from (select o_custkey, sort_array(collect_list(o_orderkey)) as a from orders group by o_custkey) t lateral view posexplode(a) p as pos, k lateral view explode(array('x', 'y')) q as x""",
        "select o_custkey, (i - 1)::int as pos, a[i] as k, x from (select o_custkey, list_sort(list(o_orderkey)) as a from orders group by o_custkey) t, unnest(range(1, len(a) + 1)) as u(i), unnest(['x', 'y']) as v(x)"),
    "outer_generators": (("orders",),
        "select o_orderkey, e from orders lateral view outer explode(filter(array(o_orderkey, o_orderkey + 1), v -> v % 4 = 0)) t as e",
        "select o_orderkey, e from orders left join lateral (select unnest(list_filter([o_orderkey, o_orderkey + 1], lambda v: v % 4 = 0)) as e) on true"),
    "inlined_structs": (("nation",),
        "select n_nationkey, a, b from nation lateral view inline(array(struct(1 as a, n_name as b), struct(2 as a, upper(n_name) as b))) t as a, b",
        "select n_nationkey, s.a as a, s.b as b from (select n_nationkey, unnest([{'a': 1, 'b': n_name}, {'a': 2, 'b': upper(n_name)}]) as s from nation)"),
    "stacked": (("nation",),
        "select n_nationkey, k, v from nation lateral view stack(2, 'name', n_name, 'region', cast(n_regionkey as string)) t as k, v",
        "select n_nationkey, unnest(['name', 'region']) as k, unnest([n_name, n_regionkey::string]) as v from nation"),
    "maps": (("orders",),
        """select o_custkey, m['F'] as f, map_contains_key(m, 'P') as p, array_join(array_sort(map_keys(m)), ',') as ks, array_join(array_sort(map_values(m)), ',') as vs, size(m) as n, element_at(map_filter(m, (k, v) -> v > 1), 'O') as o, element_at(transform_values(m, (k, v) -> v * 2), 'F') as d,
          element_at(map_concat(m, map('Z', 0L)), 'Z') as z, array_join(array_sort(transform(map_entries(m), e -> concat(e.key, e.value))), ',') as es, element_at(map_from_arrays(array('a', 'b'), array(1, 2)), 'b') as two, str_to_map('a:1,b:2')['a'] as one
        from (select o_custkey, map_from_entries(collect_list(struct(o_orderstatus, n))) as m from (select o_custkey, o_orderstatus, count(*) as n from orders group by o_custkey, o_orderstatus) group by o_custkey) t""",
        """with g as (select o_custkey, o_orderstatus as s, count(*) as n from orders group by all)
        select o_custkey, max(n) filter (s = 'F') as f, bool_or(s = 'P') as p, array_to_string(list_sort(list(s)), ',') as ks, array_to_string(list_sort(list(n)), ',') as vs, count(*)::int as n, max(n) filter (s = 'O' and n > 1) as o, max(n * 2) filter (s = 'F') as d, 0::bigint as z,
          array_to_string(list_sort(list(s || n)), ',') as es, 2 as two, '1' as one from g group by o_custkey"""),
    "structs": (("customer",),
        "select c_custkey, s.a as a, s.b.c as c, named_struct('x', 1, 'y', c_name).y as y, to_json(struct(c_custkey as k, c_name as n)) as j from (select *, struct(c_nationkey as a, struct(c_mktsegment as c) as b) as s from customer) t",
        "select c_custkey, c_nationkey as a, c_mktsegment as c, c_name as y, '{\"k\":' || c_custkey || ',\"n\":\"' || c_name || '\"}' as j from customer"),
    "json_forms": (("events",),
        """select event_id, from_json(props, 'k string').k as k, json_tuple_k, json_array_length('[1,2,3]') as n, array_join(json_object_keys(props), ',') as keys, schema_of_json('{"a":1}') as sch, to_json(map('v', event_id)) as j
        from (select *, get_json_object(props, '$.k') as json_tuple_k from events) t""",
        "select event_id, json_extract_string(props, '$.k') as k, json_extract_string(props, '$.k') as json_tuple_k, 3 as n, 'k' as keys, 'STRUCT<a: BIGINT>' as sch, '{\"v\":' || event_id || '}' as j from events"),
    "csv_xml_variant": (("nation",),
        """select n_nationkey, from_csv(concat(n_nationkey, ',', n_name), 'k int, n string').n as c, to_csv(struct(n_nationkey, n_name)) as t, xpath_string(concat('<a><b>', n_name, '</b></a>'), 'a/b') as x, from_xml(concat('<r><k>', n_nationkey, '</k></r>'), 'k int').k as xk,
          variant_get(parse_json(concat('{"k":[', n_nationkey, ',2]}')), '$.k[0]', 'int') as v, is_variant_null(parse_json('null')) as vn, schema_of_variant(parse_json('{"a":1}')) as sv, try_variant_get(parse_json('{"a":"x"}'), '$.a', 'int') is null as bad from nation""",
        "select n_nationkey, n_name as c, n_nationkey || ',' || n_name as t, n_name as x, n_nationkey as xk, n_nationkey as v, true as vn, 'OBJECT<a: BIGINT>' as sv, true as bad from nation"),
    "safe_arithmetic": (("lineitem",),
        # try_add catches an exception for each row that overflows; any number over 0 overflows as 1 does, which is folded once
        "select l_orderkey, l_linenumber, try_divide(l_quantity, l_linenumber - 1) as q, if(l_linenumber > 0, try_add(9223372036854775807L, 1L), try_add(9223372036854775807L, cast(l_linenumber as bigint))) is null as over, try_cast('x' as int) is null as bad, nvl2(nullif(l_returnflag, 'R'), 'kept', 'back') as b, if(l_tax > 0.04, 'high', 'low') as level, equal_null(null, null) as e, nanvl(double('NaN'), 1D) as nn from lineitem",
        "select l_orderkey, l_linenumber, case when l_linenumber <> 1 then l_quantity / (l_linenumber - 1) end as q, true as over, try_cast('x' as int) is null as bad, case when l_returnflag <> 'R' then 'kept' else 'back' end as b, case when l_tax > 0.04 then 'high' else 'low' end as level, true as e, 1::double as nn from lineitem"),
    "byte_checks": (("customer",),
        "select c_custkey, crc32(cast('123456789' as binary)) as crc, hex(to_binary('abc', 'utf-8')) as hx, decode(encode(c_name, 'UTF-8'), 'UTF-8') as same, char_length(c_name) as n, is_valid_utf8(c_name) as ok, cast(aes_decrypt(aes_encrypt(c_name, '0123456789abcdef'), '0123456789abcdef') as string) as aes from customer",
        "select c_custkey, 3421780262 as crc, '616263' as hx, c_name as same, length(c_name)::int as n, true as ok, c_name as aes from customer"),
    "string_lists": (("part",),
        "select p_partkey, size(split(p_name, '[aeiou]')) as n, array_join(split(p_name, ' '), '_') as joined, elt(2, 'a', p_brand, 'c') as second, find_in_set('b', 'a,b,c') as place, substring_index(p_brand, '#', 1) as head, sentences_n, left(space(3), 2) as blanks, format_string('%05d-%s', p_partkey, p_type) as f, printf('%.1f', p_retailprice) as pf from (select *, size(sentences('Hi there. Bye.')) as sentences_n from part) t",
        "select p_partkey, len(string_split_regex(p_name, '[aeiou]'))::int as n, replace(p_name, ' ', '_') as joined, p_brand as second, 2 as place, split_part(p_brand, '#', 1) as head, 2 as sentences_n, '  ' as blanks, printf('%05d-%s', p_partkey, p_type) as f, printf('%.1f', p_retailprice) as pf from part"),
}
