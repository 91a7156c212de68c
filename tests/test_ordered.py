import random
import re

import pytest
from compare import assert_same, connect
from pyspark.sql import functions as F

from loomframe import operators as O
from loomframe.operators import patterns
from loomframe.operators.patterns import Automaton
from loomframe.operators.ranges import PART, numbered, ranged
from loomframe.plans import ordered
from loomframe.sources.stages import stage


@pytest.fixture(autouse=True)
def many_partitions(spark):
    """Small tables stay in as many partitions as large ones would have."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# ranges


def test_numbered_splits_a_hot_key(spark):
    df = spark.range(20_000).select(F.when(F.col("id") < 19_000, "hot").alias("k"), (F.col("id") * 7919 % 20_011).alias("x"))
    parts = ranged(df, ["k"], ["x"])
    assert parts.where("k = 'hot'").select(PART).distinct().count() >= 6
    out = numbered(df, ["k"], ["x"])
    for key in ("hot", None):
        own = sorted((r.x, r._at, r._n) for r in out.where(F.col("k").eqNullSafe(F.lit(key))).collect())
        assert [at for _, at, _ in own] == list(range(len(own))) and {n for *_, n in own} == {len(own)}


# recursion


def test_closure_has_cycles_and_ignores_nulls(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (5, 6), (6, 7), (None, 1), (7, None), (1, 2)]
    df = spark.createDataFrame(edges, "a int, b int")
    known = {(a, b) for a, b in edges if a and b}
    while more := {(a, d) for a, b in known for c, d in known if b == c} - known:
        known |= more
    assert rows(O.closure(df, "a", "b"), "a", "b") == sorted(known, key=repr)
    assert O.closure(df.limit(0), "a", "b").count() == 0


def test_distances(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(90)]
    expected, edge, level = {0: 0, 7: 0}, {0, 7}, 0
    while edge:
        level += 1
        edge = {b for a, b in edges if a in edge} - expected.keys()
        expected |= {b: level for b in edge}
    roots = spark.createDataFrame([(0,), (7,), (7,), (None,)], "r int")
    assert rows(O.distances(spark.createDataFrame(edges, "a int, b int"), "a", "b", roots), "node", "level") == sorted(expected.items(), key=repr)


def test_long_chains(spark):
    """More rounds than files that are kept apart."""
    df = spark.range(40).select(F.col("id").cast("int").alias("a"), (F.col("id") + 1).cast("int").alias("b"))
    roots = spark.createDataFrame([(0,)], "r int")
    assert rows(O.distances(df, "a", "b", roots), "node", "level") == sorted(((k, k) for k in range(41)), key=repr)


def test_hierarchy(spark):
    df = spark.createDataFrame([(1, None, 10), (2, 1, 5), (3, 2, 1), (4, 9, 7), (5, 6, 1), (6, 5, 1), (7, None, 2), (None, 7, 3)], "n int, p int, w int")
    assert rows(O.hierarchy(df, "n", "p", "w"), "node", "root", "level", "total") == sorted([(1, 1, 0, 10), (2, 1, 1, 15), (3, 1, 2, 16), (7, 7, 0, 2), (None, 7, 1, 5)], key=repr)


# patterns


def longest(pattern, text, at):
    found = [e for e in range(at + 1, len(text) + 1) if re.fullmatch(pattern, text[at:e])]
    return max(found, default=0) - 1


def plain_matches(pattern, text, overlapping):
    out, at = [], 0
    while at < len(text):
        end = longest(pattern, text, at)
        if end >= at:
            out.append((at, end))
        at = at + 1 if overlapping or end < at else end + 1
    return out


PATTERNS = ["A+B", "A(B|C)+A", "A(B|C){0,3}C", "(AB)*C", "A?B{2,}C?", "(A|BC)+(C|A{2})", "A{2}", "(A+B+)+", "AB*"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_patterns_over_chunk_edges(spark, pattern):
    rng = random.Random(len(pattern))
    keys = {"hot": 300, "b": 40, None: 17, "one": 1}
    data, texts = [], {}
    for key, n in keys.items():
        texts[key] = "".join(rng.choice("AAABBC.") for _ in range(n))
        data += [(key, k, c) for k, c in enumerate(texts[key])]
    rng.shuffle(data)
    df = spark.createDataFrame(data, "k string, at long, kind string")
    symbols = {s: F.col("kind") == s for s in "ABC"}
    measures = {"n": F.count(F.lit(1)), "bs": F.count_if(F.col("symbol") == "B"), "first_at": F.min("at")}
    for chunk, overlapping in ((5, False), (1000, False), (3, True)):
        out = O.match_rows(df, ["k"], ["at"], symbols, pattern, measures, overlapping, chunk)
        expected = [(k, s, e, e - s + 1, t[s : e + 1].count("B"), s) for k, t in texts.items() for s, e in plain_matches(pattern, t, overlapping)]
        assert rows(out, "k", "match_start", "match_end", "n", "bs", "first_at") == sorted(expected, key=repr)


def test_keys_of_one_chunk_take_no_passes(spark, monkeypatch):
    """They are matched many in a frame; a group for each key took most of the time."""
    staged = {}
    monkeypatch.setattr(patterns, "stage", lambda df, name: staged.setdefault(name, stage(df, name)))
    data = [(None if k == 0 else k, at, kind) for k in range(50) for at, kind in enumerate("AB" * (k % 3))] + [(99, at, "A") for at in range(9)] + [(99, 9, "B")]
    df = spark.createDataFrame(data, "k int, at long, kind string")
    out = O.match_rows(df, ["k"], ["at"], {s: F.col("kind") == s for s in "AB"}, "A+B", {"n": F.count(F.lit(1))}, chunk=4)
    assert rows(out, "k", "match_start", "match_end", "n") == sorted([(k or None, 2 * j, 2 * j + 1, 2) for k in range(50) for j in range(k % 3)] + [(99, 0, 9, 10)], key=repr)
    assert [r.key for r in staged["chunks"].select("key").distinct().collect()] == ['{"_k0":99}']


def test_pattern_repeated_groups_no_user_of_one_chunk(spark, sf_dir, tmp_path, monkeypatch):
    """More users are more texts in a frame, so that its time grows as its rows do."""
    staged = {}
    monkeypatch.setattr(patterns, "stage", lambda df, name: staged.setdefault(name, stage(df, name)))
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    copies = events.crossJoin(spark.range(5).select(F.col("id").alias("copy")))
    copies = copies.withColumns({"event_id": F.col("event_id") + 1_000_000 * F.col("copy"), "user_id": F.col("user_id") + 1_000_000 * F.col("copy")})
    copies.drop("copy").write.parquet(f"{tmp_path}/events.parquet")
    assert_same(ordered.pattern_repeated(spark, str(tmp_path)), connect(tmp_path), ordered.SQL["pattern_repeated"])
    assert staged["numbered"].count() == 5 * events.count() and staged["chunks"].isEmpty()


def test_rows_alike_share_a_step():
    """Places differ from row to row, so steps are kept by what is counted from them."""
    automaton, text = Automaton("E+S"), "EES" * 5_000
    found, before = automaton.starts(text, 30, automaton.final(30 + len(text)))
    assert [(30 + k, e) for k, e in enumerate(found) if e >= 0][:3] == [(30, 32), (31, 32), (33, 35)] and before[0] == 32
    assert automaton.moved.cache_info().misses < 20


def test_patterns_refused():
    for pattern in ("", "A*", "(A", "A)", "|A", "+A", "A{3,2}", "A{0}", "A?B*"):
        with pytest.raises(ValueError):
            Automaton(pattern)


def test_patterns_of_no_rows(spark):
    df = spark.createDataFrame([], "k string, at long")
    assert O.match_rows(df, [], ["at"], {"A": F.lit(True)}, "A+", {"n": F.count(F.lit(1))}).collect() == []
    with pytest.raises(ValueError):
        O.match_rows(df, [], ["at"], {"A": F.lit(True)}, "AB", {})


# as-of joins


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("exact", [True, False])
def test_asof_like_brute_force(spark, direction, exact):
    rng = random.Random(11)
    keys = ["hot"] * 8 + ["b", None]
    left = [(k, rng.choice(keys), rng.choice([None, *range(0, 400, 2)])) for k in range(400)]
    right = [(rng.choice(keys), rng.choice([None, *range(0, 400, 3)]), k) for k in range(150)]
    out = O.asof(spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, t int, v int"), "t", ["k"], ["v"], direction, tolerance=9, exact=exact)
    expected = []
    for i, k, t in left:
        best = None
        for rk, rt, v in right:
            if k is None or t is None or rt is None or rk != k or abs(rt - t) > 9 or (rt == t and not exact):
                continue
            if (direction == "backward" and rt > t) or (direction == "forward" and rt < t):
                continue
            # nearer, then earlier, then the larger value
            rank = (abs(rt - t), rt, -v)
            best = min(best, (rank, v)) if best else (rank, v)
        expected.append((i, k, t, best and best[1]))
    assert rows(out, "i", "k", "t", "v") == sorted(expected, key=repr)


def test_asof_spreads_one_key(spark):
    """All rows in one group: the windows' groups are that group's partitions."""
    df = spark.range(50_000).select(F.col("id").alias("i"), (F.col("id") * 48_271 % 65_537).alias("t"))
    out = O.asof(df, df.select("t", F.col("i").alias("v")), "t", [], ["v"])
    assert out.where("v is null").count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    # single partitions hold a row for each partition only, which are aggregated
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin Inner" not in plan
    with pytest.raises(ValueError):
        O.asof(df, df, "t", [], [], "sideways")


# overlaps


def test_overlaps_of_short_and_long_intervals(spark):
    rng = random.Random(5)

    def made(n):
        out = []
        for k in range(n):
            start = rng.randrange(-500, 500)
            out.append((k, rng.choice(["x", "x", "y", None]), start, start + rng.choice([0, 1, 3, 7, 8, 60, 64, 511, 900, -1])))
        return out + [(n, "x", None, 5), (n + 1, "y", 3, None)]

    left, right = made(150), made(120)
    lhs, rhs = spark.createDataFrame(left, "i int, k string, s int, e int"), spark.createDataFrame([(k, i, s, e) for i, k, s, e in right], "k string, j int, rs int, re int")
    out = O.overlap_join(lhs, rhs, ["k"], (F.col("s"), F.col("e")), (F.col("rs"), F.col("re")))
    expected = [(i, j) for i, k, s, e in left for j, rk, rs, re_ in right if k is not None and k == rk and None not in (s, e, rs, re_) and s <= e and rs <= re_ and max(s, rs) <= min(e, re_)]
    assert rows(out, "i", "j") == sorted(expected, key=repr)
    with pytest.raises(ValueError):
        O.overlap_join(lhs, lhs, ["k"], (F.col("s"), F.col("e")), (F.col("s"), F.col("e")))


def test_rows_sent_are_linear(spark):
    """Intervals of one key, all of one level and spread over the axis: candidates follow the intervals."""
    met = {}
    for n in (1000, 4000):
        df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("i"), (F.col("id") * 10).alias("s"), (F.col("id") * 10 + 9).alias("e"))
        other = df.select("k", F.col("i").alias("j"), F.col("s").alias("rs"), F.col("e").alias("re"))
        met[n] = O.overlap_join(df, other, ["k"], (F.col("s"), F.col("e")), (F.col("rs"), F.col("re"))).count()
    assert met == {1000: 1000, 4000: 4000}


# quantiles


def test_quantiles(spark):
    data = [("a", float(k % 50)) for k in range(999)] + [("b", 3.0), ("c", None), (None, 1.0), (None, 4.0), ("a", None)]
    df = spark.createDataFrame(data, "k string, v double")
    shares = {"lo": 0.0, "q": 0.25, "m": 0.5, "p": 0.9, "hi": 1.0}
    plain = df.groupBy("k").agg(*[F.percentile("v", x).alias(n) for n, x in shares.items()])
    found = O.quantiles(df, ["k"], "v", shares)
    assert rows(found, "k", *shares) == rows(plain, "k", *shares)
    assert "ObjectHashAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    discrete = df.groupBy("k").agg(*[F.expr(f"percentile_disc({x}) within group (order by v)").alias(n) for n, x in shares.items()])
    assert rows(O.quantiles(df, ["k"], "v", shares, discrete=True), "k", *shares) == rows(discrete, "k", *shares)
    assert rows(O.quantiles(df, [], "v", {"m": 0.5}), "m") == rows(df.agg(F.median("v").alias("m")), "m")


# frames


@pytest.mark.parametrize("exclude", ["no others", "current row", "group", "ties"])
@pytest.mark.parametrize("before, after", [(2, 1), (0, 0), (0, 3)])
def test_frames_excluding(spark, exclude, before, after):
    rng = random.Random(before)
    data = [(k, rng.choice(["a", "a", None]), rng.choice([None, *range(0, 90, 3)]), rng.choice([None, 1, 2, 2, 5, 9])) for k in range(300)]
    df = spark.createDataFrame(data, "i int, k string, t int, v int")
    out = O.frame_excluding(df, ["k"], "t", "v", before, after, exclude, ("n", "s", "lo", "hi"), spread=4)
    expected = []
    for i, k, t, v in data:
        order = sorted({r[2] for r in data if r[1] == k}, key=lambda x: (x is not None, x))
        at = order.index(t)
        frame = set(order[max(at - before, 0) : at + after + 1])
        kept = [r for r in data if r[1] == k and r[2] in frame]
        if exclude != "no others":
            kept = [r for r in kept if (r[2] != t) or (exclude == "current row" and r[0] != i) or (exclude == "ties" and r[0] == i)]
        values = [r[3] for r in kept if r[3] is not None]
        expected.append((i, len(values), sum(values) if values else None, min(values, default=None), max(values, default=None)))
    assert rows(out, "i", "n", "s", "lo", "hi") == sorted(expected, key=repr)
