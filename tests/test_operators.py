import datetime
import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomframe import functions as L
from loomframe import operators as O


def day(k):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=k)


def test_asof_ties_misses_and_nulls(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 9, "c"), (3, 1, "d"), (1, 5, "a")], "k int, t int, v string")
    right = spark.createDataFrame([(1, 2, 10), (1, 5, 20), (1, 5, 30), (2, 10, 40), (2, 3, None)], "k int, t int, w int")
    got = sorted((r.k, r.t, r.v, -1 if r.w is None else r.w) for r in O.asof_join(left, right, "t", ["k"], ["w"]).collect())
    assert got == [(1, 1, "b", -1), (1, 5, "a", 30), (1, 5, "a", 30), (2, 9, "c", -1), (3, 1, "d", -1)]


def test_asof_null_keys_and_times(spark):
    left = spark.createDataFrame([(None, 5, "a"), (1, None, "b"), (1, 5, "c"), (None, None, "d")], "k int, t int, v string")
    right = spark.createDataFrame([(None, 1, 99), (1, None, 10), (None, None, 7)], "k int, t int, w int")
    assert sorted((r.v, r.w) for r in O.asof_join(left, right, "t", ["k"], ["w"]).collect()) == [("a", None), ("b", None), ("c", None), ("d", None)]


def test_not_in(spark):
    left = spark.createDataFrame([(1,), (2,), (None,), (2,)], "x int")
    for values, want in (([2, 3, 2], [1]), ([2, None], []), ([None], []), ([], [None, 1, 2, 2])):
        right = spark.createDataFrame([(v,) for v in values], "y int")
        got = O.not_in(left, "x", right, "y")
        assert sorted((r.x for r in got.collect()), key=lambda v: (v is not None, v)) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        big = O.not_in(left, "x", spark.range(10).select(F.col("id").cast("int").alias("y")), "y")
        assert "SortMergeJoin" in big._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ranks_and_groups_frames_over_runs(spark):
    """Ranks that are dealt over runs of values equal plain windows, nulls, ties and null keys included."""
    rows = [(k, "ab"[k % 2] if k % 17 else None, None if k % 13 == 0 else k * k % 31) for k in range(200)]
    df = spark.createDataFrame(rows, "id int, k string, v int")
    w = Window.partitionBy("k").orderBy("v")
    plain = df.select("id", F.rank().over(w).alias("rank"), F.dense_rank().over(w).alias("dense_rank"), F.row_number().over(Window.partitionBy("k").orderBy("v", "id")).alias("row_number"),
                      F.percent_rank().over(w).alias("percent_rank"), F.cume_dist().over(w).alias("cume_dist"), F.ntile(7).over(Window.partitionBy("k").orderBy("v", "id")).alias("ntile"))
    got = O.ranked(df, ["k"], "v", F.floor(F.col("v") / 4), ["id"], tiles=7).select(plain.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))
    for spread in (1, 3, 64):
        for before, after in ((2, 0), (0, 3), (1, 1), (5, 5)):
            agg = {"n": F.count(F.lit(1)), "s": F.sum("v"), "top": F.max("v")}
            one, many = O.groups_frame(df, ["k"], "v", before, after, agg), O.groups_frame(df, ["k"], "v", before, after, agg, F.floor(F.col("v") / 4), spread)
            assert sorted(map(str, one.collect())) == sorted(map(str, many.select(one.columns).collect()))


def test_interval_join_equals_brute_force(spark):
    points = [(k % 3, k * 7 % 50) for k in range(60)]
    spans = [(k % 3, k * 5 % 40, k * 5 % 40 + k % 20 - 2) for k in range(40)]
    left = spark.createDataFrame(points, "k int, p int")
    right = spark.createDataFrame(spans, "k int, a int, b int")
    want = sorted((k, p, a, b) for k, p in points for j, a, b in spans if j == k and a <= p <= b)
    for width in (1.0, 6.0, 1000.0):
        assert sorted(tuple(r) for r in O.interval_join(left, right, ["k"], F.col("p"), F.col("a"), F.col("b"), width).collect()) == want


def test_salted_join_keeps_rows(spark):
    left = spark.createDataFrame([(1 if k < 90 else k, k) for k in range(100)], "k int, v int")
    right = spark.createDataFrame([(1, "x"), (95, "y")], "k int, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert sorted(map(str, O.salted_join(left, right, ["k"], 7, how).collect())) == sorted(map(str, left.join(right, "k", how).collect()))
    with pytest.raises(ValueError):
        O.salted_join(left, right, ["k"], 7, "full")


def test_sessions_and_gaps(spark):
    rows = [("a", day(0)), ("a", day(1)), ("a", day(3)), ("a", day(3)), ("b", day(9))]
    got = O.sessionize(spark.createDataFrame(rows, "u string, ts timestamp_ntz"), ["u"], "ts", 3600).collect()
    assert sorted((r.u, r.ts, r.session) for r in got) == [("a", day(0), 1), ("a", day(1), 1), ("a", day(3), 2), ("a", day(3), 2), ("b", day(9), 1)]
    daily = spark.createDataFrame([("a", datetime.date(2024, 1, 1), 5), ("a", datetime.date(2024, 1, 4), 7)], "u string, d date, n int")
    assert [(r.d.day, r.n) for r in O.gap_fill(daily, ["u"], "d", "1 day", ["n"]).orderBy("d").collect()] == [(1, 5), (2, 5), (3, 5), (4, 7)]


def test_number_functions(spark):
    pairs = [(a, b) for a in (-12, 0, 1, 18, 2**62, None) for b in (-8, 0, 7, 2**61, None)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", L.gcd(F.col("a"), F.col("b")).alias("g")).collect()
    for r in got:
        assert r.g == (None if None in (r.a, r.b) else math.gcd(r.a, r.b))
    some = [(4, 6), (0, 5), (-3, 7), (None, 1), (0, None), (1, 2**53 + 1), (3, 3 * (2**53 + 1)), (2**31, 2**31 - 1), (6, -(2**60))]
    few = spark.createDataFrame(some, "a long, b long").select("a", "b", L.lcm(F.col("a"), F.col("b")).alias("l")).collect()
    assert [r.l for r in few] == [None if None in p else math.lcm(*p) for p in some]


def test_vector_functions(spark):
    rows = [([1.0, 2.0], [2.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), ([1.0, None], [1.0, 2.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = df.select(L.dot(a, b).alias("d"), L.cosine(a, b).alias("c"), L.l2_distance(a, b).alias("l"), L.norm(a).alias("n")).collect()
    assert got[0].d == 4 and abs(got[0].c - 0.8) < 1e-12 and abs(got[0].l - 2**0.5) < 1e-12 and abs(got[0].n - 5**0.5) < 1e-12
    assert got[1].c is None and got[2].d is None and got[2].l is None and got[3].d is None


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "k int, t timestamp_ntz, v int")
    assert O.sessionize(e, ["k"], "t", 5).collect() == [] and O.asof_join(e, e.select("k", "t", F.col("v").alias("w")), "t", ["k"], ["w"]).collect() == []
    assert O.top_k(e, ["k"], [F.col("v")], 3).collect() == [] and O.groups_frame(e, ["k"], "v", 1, 1, {"n": F.count("*")}).collect() == []


def test_funnel(spark):
    rows = [("a", 0, "x"), ("a", 1, "y"), ("a", 2, "z"), ("b", 0, "x"), ("b", 99, "y"), ("c", 0, "y"), ("c", 1, "x"), ("d", 0, "x"), ("d", 50, "x"), ("d", 51, "y"), ("d", 99, "z"), ("e", 3, "x"), ("e", 3, "y")]
    df = spark.createDataFrame([(u, day(t), k) for u, t, k in rows], "u string, ts timestamp_ntz, kind string")
    got = {r.u: r.reached for r in O.funnel(df, ["u"], "ts", "kind", ["x", "y", "z"], 10 * 3600).collect()}
    assert got == {"a": 3, "b": 1, "c": 1, "d": 2, "e": 2}
