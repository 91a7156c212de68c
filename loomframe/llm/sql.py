"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _count(column: str, chars: str) -> str:
    return f"(length({column}) - length(translate({column}, '{chars}', '')))"


# Fixed values, written apart from the operator's: what each language's pages say, as a regular expression.
_EN = r"all rights reserved|click here|cookie policy|javascript|log in|lorem ipsum|privacy policy|read more|sign up|subscribe now|terms of (service|use)"
_ES = r"aviso legal|haga clic aquí|iniciar sesión|leer más|política de (cookies|privacidad)|todos los derechos reservados|términos de uso"
_FR = r"cliquez ici|conditions d''utilisation|lire la suite|mentions légales|politique de confidentialité|se connecter|tous droits réservés"
_DE = r"alle rechte vorbehalten|datenschutzerklärung|hier klicken|jetzt anmelden|mehr lesen|nutzungsbedingungen"
_STOCK = rf"regexp_matches(lower(line), '(^|[^\p{{L}}\p{{N}}])({_EN}|{_ES}|{_FR}|{_DE})($|[^\p{{L}}\p{{N}}])')"

OP1_SQL = rf"""
with d as (select row_number() over () as rid, doc_id, text, coalesce(text, '') as t from documents),
w as (select rid, {WORDS.format("t")} as words from d),
win as (select rid, i, list_slice(words, i, i + 4) as g from w, unnest(range(1, len(words) - 3)) as u(i)),
again as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from win) where c >= 2),
covered as (select rid, count(distinct i + k) as n from again, range(0, 5) as r(k) group by rid),
ls as (select rid, k, lines[k] as line from (select rid, string_split(t, chr(10)) as lines from d), unnest(range(1, len(lines) + 1)) as u(k)),
lw as (select rid, k, line, len({WORDS.format("line")}) as n from ls),
judged as (select *, case when n = 0 then null
  when {_count("line", "|»›•")} >= 2 and {_count("line", "|»›•")} * 6 >= n then 'navigation'
  when {_count("line", "#*$%&|<>")} * 10 > n * 3 or ({_count("line", "!?")} * 10 > n * 3 and {_count("line", "!?")} > 1)
    or not regexp_matches(line, '[.!?…:;"''”’»)\]。！？；：」』؟।][\x20\x09-\x0D]*$') then 'punctuation'
  when {_STOCK} then 'boilerplate' end as rule from lw),
docs as (select rid, sum(n) filter (rule is not null) as lost, count(*) filter (rule is not null) as failed,
  count(*) filter (n > 0) - count(distinct case when n > 0 then line end) as dups,
  coalesce(string_agg(line, chr(10) order by k) filter (rule is null), '') as clean from judged group by rid),
m as (select d.doc_id, d.text, len(w.words) as n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as word_chars, {_count("t", "#*$%&|<>")} as n_symbols,
  dups as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words, coalesce(lost, 0) as lost_words, failed as n_failed_lines, clean
  from d join w using (rid) join docs using (rid) left join covered using (rid)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and lost_words <= 0.5 * n_words as kept, lost_words::bigint as lost_words,
  n_failed_lines::bigint as n_failed_lines, case when text is not null then md5(clean) end as clean_md5 from b
"""

#: The turn-taking fill as a recursion: step t is shard t % 64; its claim is its first free slot.
OP7_SQL = r"""
with recursive shards as (
  select k, ('0x' || substr(md5('shard-' || lpad(k::varchar, 5, '0') || '/offset'), 1, 15))::bigint % 8191 as o,
    ('0x' || substr(md5('shard-' || lpad(k::varchar, 5, '0') || '/skip'), 1, 15))::bigint % 8190 + 1 as s from range(64) as r(k)),
plan as (select list(o order by k) as os, list(s order by k) as ss from shards),
claim as (
  select 0::bigint as t, [0::tinyint for x in range(8191)] as taken, [0::bigint for x in range(64)] as ptr, null::bigint as slot
  union all
  select t + 1, list_slice(taken, 1, c) || [1::tinyint] || list_slice(taken, c + 2, 8191), list_slice(ptr, 1, t % 64) || [j + 1] || list_slice(ptr, t % 64 + 2, 64), c
  from (select t, taken, ptr, j, (os[t % 64 + 1] + j * ss[t % 64 + 1]) % 8191 as c
    from (select t, taken, ptr, os, ss, list_filter(range(ptr[t % 64 + 1], 8191), lambda j: taken[(os[t % 64 + 1] + j * ss[t % 64 + 1]) % 8191 + 1] = 0)[1] as j
      from claim, plan where t < 8191))
)
select doc_id, source, h.slot, ((t - 1) % 64)::int as shard
from (select doc_id, source, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint % 8191 as slot from documents) h
join claim on claim.slot = h.slot
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2_SQL = rf"""
with recursive d as (select row_number() over () as rid, doc_id, {WORDS.format(_LOWER)} as words from documents),
sh as (select distinct rid, g from (
  select rid, list_slice(words, i, i + 4) as g from d, unnest(range(1, len(words) - 3)) as u(i) where len(words) >= 5
  union all select rid, words from d where len(words) between 1 and 4)),
n as (select rid, count(*) as n from sh group by rid),
pairs as (select a.rid as x, b.rid as y, count(*) as c from sh a join sh b on a.g = b.g and a.rid <> b.rid group by x, y),
links as (select dx.doc_id as a, dy.doc_id as b from pairs join n nx on nx.rid = x join n ny on ny.rid = y
  join d dx on dx.rid = x join d dy on dy.rid = y where 100 * c >= 80 * (nx.n + ny.n - c)),
reach as (select distinct doc_id as a, doc_id as b from d union select reach.a, links.b from reach join links on links.a = reach.b),
comp as (select a, min(b) as component_id from reach group by a)
select doc_id, coalesce(n.n, 0)::bigint as n_shingles, component_id from d left join n using (rid) left join comp on comp.a = doc_id
"""

_FORM = r"trim(regexp_replace(lower(piece), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')"

OP10_SQL = rf"""
with d as (select row_number() over () as rid, doc_id, text from documents),
cutup as (select rid, doc_id, string_split(replace(regexp_replace(text, '([.!?])([\x20\x09\x0B-\x0D])', '\1' || chr(1) || '\2', 'g'), chr(10), chr(10) || chr(1)), chr(1)) as ps from d where text is not null),
u as (select rid, doc_id, k, ps[k] as piece from cutup, unnest(range(1, len(ps) + 1)) as r(k)),
f as (select *, {_FORM} as form, length(piece) as n, sum(length(piece)) over (partition by rid order by k) - length(piece) as start from u),
solid as (select *, len(string_split(form, ' ')) as words,
  (doc_id, k) <> first_value((doc_id, k)) over (partition by form order by doc_id, k) as again from f where form <> ''),
isle as (select *, sum(case when again then 0 else 1 end) over (partition by rid order by k rows unbounded preceding) as island from solid),
runs as (select rid, island, min(k) as a, max(k) as b, sum(words) as words, count(*) as units, min(start) as s, max(start + n) as e from isle where again group by rid, island having sum(words) >= 25),
gone as (select rid, string_agg(s || '-' || e, ';' order by s) as spans, sum(units) as n_removed, sum(words) as removed_words from runs group by rid),
kept as (select f.rid, string_agg(piece, '' order by k) as clean from f where not exists (select 1 from runs r where r.rid = f.rid and f.k between r.a and r.b) group by f.rid),
counted as (select rid, count(*) as n_units from solid group by rid)
select d.doc_id, case when d.text is not null then coalesce(clean, '') end as text, coalesce(spans, '') as spans,
  coalesce(n_units, 0)::bigint as n_units, coalesce(n_removed, 0)::bigint as n_removed, coalesce(removed_words, 0)::bigint as removed_words
from d left join gone using (rid) left join kept using (rid) left join counted using (rid)
"""

OP6_SQL = """
with recursive v as (select row_number() over () as rid, vec_id, label, embedding::double[] as e from embeddings),
ok as (select * from v where label is not null and e is not null and len(e) > 0
  and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select a.rid, a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and a.rid <> b.rid and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.98),
n as (select rid, count(*) as n from links group by rid),
reach as (select distinct vec_id as a, vec_id as b from v union select reach.a, links.b from reach join links on links.a = reach.b),
comp as (select a, min(b) as component_id from reach group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from v left join n using (rid) left join comp on comp.a = vec_id
"""

_LEN = "(length({0}) + length({0}) - length(translate({0}, '\\<[{1}', '')))"

OP4_SQL = rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, role as r0, text as t0 from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', ''),
g as (select conv_id, count(*)::bigint as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, r0 nulls first, t0 nulls first) as turns,
  coalesce(string_agg(text, '' order by turn nulls first, r0 nulls first, t0 nulls first) filter (role = 'assistant'), '') as loss,
  sum({_LEN.format("text", "")} + {_LEN.format("role", chr(10))} + 24)::bigint as formatted_chars from c group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars from g
"""


def _crc32(text: str) -> str:
    """The checksum, bit by bit, of an ASCII text."""
    return f"""xor(list_reduce(list_transform(string_split({text}, ''), lambda ch: ascii(ch)::bigint),
      lambda c, b: list_reduce(range(8), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end, xor(c, b)), 4294967295::bigint), 4294967295)"""


def _tree(name: str, leaves: str, levels: int) -> str:
    """{name}0 are the leaves (t, pos, h, c: tree, place, hash, nodes of the level) and the following levels above them;
    {name}s0 and so on have what stands left and right of a node in its run."""
    parts = [f"{name}0 as materialized ({leaves})"]
    for k in range(levels):
        parts.append(f"""{name}{k + 1} as materialized (select t, pos // 8 as pos, (any_value(c) + 7) // 8 as c,
  case when any_value(c) = 1 then min(h) else sha256(string_agg(h, '' order by pos)) end as h from {name}{k} group by t, pos // 8)""")
        parts.append(f"""{name}s{k} as materialized (select a.t, a.pos, any_value(a.c) as c, coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos < a.pos), '') as l,
  coalesce(string_agg(b.h, '' order by b.pos) filter (b.pos > a.pos), '') as r from {name}{k} a join {name}{k} b on a.t = b.t and a.pos // 8 = b.pos // 8 group by a.t, a.pos)""")
    return ",\n".join(parts)


def _climb(name: str, steps: str, levels: int, start: str) -> str:
    """{start} (rid, t, pos, p, f: siblings so far, node) carried up all levels."""
    parts, last = [], start
    for k in range(levels):
        parts.append(f"""{steps}{k} as materialized (select rid, x.t, x.pos // 8 as pos, p || s.l || s.r as p, case when s.c = 1 then f else sha256(s.l || f || s.r) end as f
  from {last} x join {name}s{k} s on x.t = s.t and x.pos = s.pos)""")
        last = f"{steps}{k}"
    return ",\n".join(parts)


_FIELDS = "concat({})".format(", ".join(f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{0}")))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12_SQL = f"""
with d as materialized (select row_number() over () as rid, doc_id, coalesce(':' || lang, '') as t, sha256({_FIELDS.format("text")}) as h,
  case when {_crc32("doc_id::varchar")} % 3 = 0 then sha256({_FIELDS.format(_LOWER)}) end as bad from documents),
r as materialized (select *, row_number() over (partition by t order by doc_id nulls first, h) - 1 as pos, count(*) over (partition by t) as c from d),
{_tree("n", "select t, pos, h, c from r", 7)},
roots as materialized (select '' as t, t as key, h, row_number() over (order by encode(t)) - 1 as pos, count(*) over () as c from n7),
{_tree("u", "select t, pos, h, c from roots", 4)},
x as (select rid, t, pos, '' as p, coalesce(bad, h) as f from r),
{_climb("n", "x", 7, "x")},
y as (select rid, roots.t, roots.pos, p, f from x6 join roots on x6.t = roots.key),
{_climb("u", "y", 4, "y")}
select doc_id, r.h as leaf, roots.h as subroot, u4.h as root, sha256(y3.p) as proof_sha256, y3.f as folded_root, y3.f = u4.h as verified
from r join y3 using (rid) join roots on r.t = roots.key, u4
"""


def _kmeans(rounds: int) -> str:
    """Plain k-means: all distances in each round, and exact means."""
    nearest = """
a{r} as materialized (select rid, min_by(c, d * 64 + c) as c, min(d) as d from (
  select k.rid, m.c, list_sum(list_transform(range(1, 65), lambda i: (k.q[i] - m.q[i]) * (k.q[i] - m.q[i]))) as d from kept k, c{r} m) group by rid)"""
    moved = """
c{n} as materialized (select m.c, coalesce(f.q, m.q) as q from c{r} m left join (
  select c, list(x order by i) as q from (select a.c, i, floor(sum(k.q[i]) / count(*))::bigint as x from a{r} a join kept k using (rid), range(1, 65) as t(i) group by a.c, i) group by c) f on m.c = f.c)"""
    parts = [nearest.format(r=0)]
    for r in range(rounds):
        parts += [moved.format(r=r, n=r + 1), nearest.format(r=r + 1)]
    return ",".join(parts)


OP13_SQL = rf"""
with kept as materialized (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and not isnan(x) and not isinf(x))) = 64),
c0 as materialized (select row_number() over (order by h, q) - 1 as c, q from (select sha256('2:' || vec_id) as h, q from kept order by h, q limit 40)),{_kmeans(5)}
select k.vec_id, a.c::int as cluster, a.d::bigint as distance, sum(a.d) over (partition by a.c)::bigint as cluster_inertia, sum(a.d) over ()::bigint as inertia,
  sha256(array_to_string(m.q, ',')) as centroid_sha256 from kept k join a5 a using (rid) join c5 m on a.c = m.c
"""
