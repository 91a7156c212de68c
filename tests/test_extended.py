import datetime
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe import functions as L
from loomframe import streaming
from loomframe.sources import committed, read_committed, replay, stream_committed, write_committed

START = datetime.datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else START + datetime.timedelta(seconds=seconds)


# table functions


def test_thinned_like_brute_force(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice(["a", "b", None]), at(rng.choice([None, *range(0, 500, 7)])), "x") for k in range(300)]
    df = spark.createDataFrame(rows, "id int, who string, at timestamp_ntz, extra string")
    expected = []
    for key in ("a", "b", None):
        last, n = None, 0
        for r in sorted((r for r in rows if r[1] == key and r[2] is not None), key=lambda r: (r[2], r[0])):
            if last is None or (r[2] - last).total_seconds() >= 30:
                last, n = r[2], n + 1
                expected.append((*r, n))
    out = L.thinned(df, "who", "at", "id", 30)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(expected, key=repr)
    assert L.thinned(df.limit(0), "who", "at", "id", 30).collect() == []
    for bad in (("nobody", "at", "id", 30), ("who", "at", "id", -1)):
        with pytest.raises(Exception, match="no column|number of seconds"):
            L.thinned(df, *bad).collect()


# mergeable aggregates


def test_spread_merges(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(500, 3)) * [5, 1, 0.1]
    rows = [("hot" if k % 9 else None, [float(x) for x in v]) for k, v in enumerate(vectors)]
    rows += [("hot", None), ("hot", [1.0, 2.0]), ("hot", [float("nan"), 0.0, 0.0]), ("one", [1.0, 2.0, 3.0]), ("same", [1.0] * 3), ("same", [1.0] * 3), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v array<double>").repartition(7)
    for fan_in in (1, 64):
        found = {r.k: r for r in L.aggregated(df, "k", "v", L.Spread(3), fan_in).collect()}
        assert set(found) == {"hot", None, "one", "same", "none"}
        for key in ("hot", None):
            own = np.array([v for k, v in rows[:500] if k == key])
            c = np.cov(own.T)
            assert found[key].n == len(own) and np.isclose(found[key].variance, np.trace(c)) and np.isclose(found[key].dimension, np.trace(c) ** 2 / (c * c).sum())
        assert (found["one"].n, found["one"].variance, found["none"].n) == (1, None, 0)
        assert (found["same"].variance, found["same"].dimension) == (0.0, None)
    assert L.aggregated(df.limit(0), "k", "v", L.Spread(3)).collect() == []


def test_a_task_hands_on_a_row_for_each_key(spark):
    df = spark.range(0, 40_000, numPartitions=4).select(F.lit("hot").alias("k"), F.array(F.col("id").cast("double")).alias("v"))
    whole = L.aggregated(df, "k", "v", L.Spread(1))
    assert whole.collect()[0].n == 40_000
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and plan.count("FlatMapGroupsInPandas") == 2


# the data source


@pytest.fixture
def place(tmp_path):
    return f"file://{tmp_path}/table"


def test_commits(spark, place, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") % 7).cast("string").alias("s"), F.when(F.col("id") % 5 != 0, F.col("id") / 2).alias("x"), F.lit(START).cast("timestamp_ntz").alias("t"))
    write_committed(df.where("id < 600").repartition(3), place)
    write_committed(df.where("id >= 600"), place)
    assert sorted(map(tuple, read_committed(spark, place).collect())) == sorted(map(tuple, df.collect()))
    assert committed.last_commit(place) == 1
    for condition in ("id = 5", "id > 990 and s = '3'", "s in ('1', '2') and x is not null", "x is null", "id <= 3 or id >= 998", "s like '1%'", "t < timestamp_ntz'2025-01-01 00:00:00'"):
        assert read_committed(spark, place).where(condition).count() == df.where(condition).count()
    # a file that no commit names isn't read
    stray = next(f for f in os.listdir(f"{tmp_path}/table/data") if f.endswith(".parquet"))
    os.link(f"{tmp_path}/table/data/{stray}", f"{tmp_path}/table/data/stray.parquet")
    assert read_committed(spark, place).count() == 1000
    write_committed(df.limit(3), place, overwrite=True)
    assert read_committed(spark, place).count() == 3


def test_a_failed_write_leaves_nothing(spark, place, tmp_path):
    df = spark.range(100).select("id")
    write_committed(df, place)
    before = sorted(os.listdir(f"{tmp_path}/table/data"))

    def broken(batches):
        for batch in batches:
            yield batch
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        write_committed(df.repartition(2).mapInArrow(broken, "id long"), place)
    assert sorted(os.listdir(f"{tmp_path}/table/data")) == before and read_committed(spark, place).count() == 100


def test_row_groups_are_pruned(tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyspark.sql.datasource import GreaterThan, StringContains

    pq.write_table(pa.table({"n": list(range(1000))}), f"{tmp_path}/plain.parquet", row_group_size=100)
    reader = committed.Reader(f"file://{tmp_path}/plain.parquet")
    assert list(reader.pushFilters([GreaterThan(("n",), 850), StringContains(("s",), "x")])) == [StringContains(("s",), "x")]
    assert [p.group for p in reader.partitions()] == [8, 9]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 149


def test_commits_are_a_stream(spark, place, tmp_path):
    state = {"path": f"{tmp_path}/out", "checkpoint": f"{tmp_path}/state"}
    for k in range(3):
        write_committed(spark.range(k * 10, k * 10 + 10).select("id"), place)
        if k != 1:
            out = streaming.run_available(stream_committed(spark, place), **state)
            # each commit once, whenever it is met
            assert sorted(r.id for r in out.collect()) == list(range(k * 10 + 10))


# replayed streams


def events(spark, rows):
    return spark.createDataFrame([(u, at(60 * m), k) for u, m, k in rows], "who int, at timestamp_ntz, kind string")


def test_timers_end_sessions(spark, tmp_path):
    """By a later row, by the timer in a batch without the key's rows, and not at all while open."""
    rows = [(1, 0, "a"), (1, 10, "b"), (1, 100, "a"), (2, 5, "c"), (2, 5, "c"), (3, 400, "a"), (1, 401, "b"), (4, 600, "z")]
    df = events(spark, rows)
    stream = replay(df, F.floor(F.minute("at") * 0 + F.hour("at") / 4), 3, files=1)
    with streaming.rocksdb(spark):
        out = streaming.run_available(streaming.timed_sessions(stream, "who", "at", "kind", "30 minutes", "0 minutes"), f"{tmp_path}/out", f"{tmp_path}/state")
    found = sorted((r.who, r.opened, r.closed, r.n, r.kinds) for r in out.collect())
    assert found == [(1, at(0), at(2400), 2, "a:1,b:1"), (1, at(6000), at(7800), 1, "a:1"), (1, at(24060), at(25860), 1, "b:1"), (2, at(300), at(2100), 2, "c:2"), (3, at(24000), at(25800), 1, "a:1")]


def test_sessions_wait_for_the_watermark(spark, tmp_path):
    """A later row of the key doesn't give a session that the watermark hasn't passed; one that comes late, but ahead of the watermark, joins two."""
    rows = [(1, 0, "a"), (1, 70, "b"), (1, 105, "a"), (2, 60, "a"), (2, 100, "b"), (2, 80, "c"), (2, 81, None), (3, 119, "z"), (None, 5, "a")]
    df = events(spark, rows).withColumn("late", F.col("kind").eqNullSafe("c") | F.col("kind").isNull())
    stream = replay(df, F.lit(0), 2, F.col("late"), 1, files=1)
    with streaming.rocksdb(spark):
        out = streaming.run_available(streaming.timed_sessions(stream, "who", "at", "kind", "30 minutes", "1 hour"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted((r.who, r.opened, r.closed, r.n, r.kinds) for r in out.collect()) == [(1, at(0), at(1800), 1, "a:1")]
    with streaming.rocksdb(spark):
        more = replay(df.union(events(spark, [(4, 500, "z")]).withColumn("late", F.lit(False))), F.when(F.col("who") == 4, 2).otherwise(0), 3, F.col("late"), 1, files=1)
        out = streaming.run_available(streaming.timed_sessions(more, "who", "at", "kind", "30 minutes", "1 hour"), f"{tmp_path}/out2", f"{tmp_path}/state2")
    assert [(r.opened, r.closed, r.n, r.kinds) for r in out.collect() if r.who == 2] == [(at(3600), at(7800), 4, "a:1,b:1,c:1")]


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    rows = [(k % 3, 7 * k, "a") for k in range(100)]
    df = events(spark, rows).withColumn("late", F.col("who") == 0)
    seen = []
    stream = replay(df, F.floor(F.hour("at") / 3), 4, F.col("late"), 3, files=1)
    out = streaming.run_available(streaming.deduplicated(stream, "at", ["who", "at"], "1 minute"), f"{tmp_path}/out", f"{tmp_path}/state", done=lambda q: seen.append(streaming.dropped_late(q)))
    lost = df.where("late and floor(hour(at) / 3) + 3 < 4").count()
    assert lost > 0 and seen == [lost] and out.count() == 100 - lost
