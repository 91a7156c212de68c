import datetime

from pyspark.sql import functions as F

from loomframe import streaming
from loomframe.sources import files

SCHEMA = "event_id long, user_id long, ts timestamp_ntz, value double"


def at(minutes):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minutes)


def dropped(spark, folder, *batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/b{k:02d}")
    return files.stream(spark, f"{folder}/*", SCHEMA, files_per_batch=1)


def test_windows_and_sessions_end_with_the_watermark(spark, tmp_path):
    rows = [(k, k % 2, at(k * 10), 1.0) for k in range(30)]
    stream = dropped(spark, f"{tmp_path}/in", rows[:15], rows[15:])
    sums = streaming.window_sums(stream, "ts", "1 hour", ["user_id"], {"n": F.count("*")}, "30 minutes")
    got = streaming.run_available(sums, f"{tmp_path}/w", f"{tmp_path}/ws").collect()
    assert got and all(r.n == 3 for r in got) and max(r.window_end for r in got) <= at(290) - datetime.timedelta(minutes=30)
    whole = streaming.run_available(sums, f"{tmp_path}/c", f"{tmp_path}/cs", "complete")
    assert whole.agg(F.sum("n")).first()[0] == 30
    sessions = streaming.session_counts(dropped(spark, f"{tmp_path}/in2", [(1, 1, at(0), 1.0), (2, 1, at(5), 1.0), (3, 1, at(60), 1.0)], [(4, 2, at(600), 1.0)]), "ts", "10 minutes", ["user_id"], "1 minute")
    done = streaming.run_available(sessions, f"{tmp_path}/s", f"{tmp_path}/ss").orderBy("session_start").collect()
    assert [(r.user_id, r.n) for r in done] == [(1, 2), (1, 1)]


def test_dedup_and_interval_pairs(spark, tmp_path):
    stream = dropped(spark, f"{tmp_path}/in", [(1, 1, at(0), 1.0), (1, 1, at(1), 1.0)], [(2, 1, at(2), 1.0), (1, 1, at(3), 1.0)])
    got = streaming.run_available(streaming.deduplicated(stream, "ts", ["event_id"], "1 hour"), f"{tmp_path}/d", f"{tmp_path}/ds").collect()
    assert sorted(r.event_id for r in got) == [1, 2]
    left = dropped(spark, f"{tmp_path}/l", [(1, 7, at(0), 1.0), (2, 8, at(0), 1.0)]).select("event_id", "user_id", "ts")
    right = dropped(spark, f"{tmp_path}/r", [(3, 7, at(4), 1.0), (4, 7, at(40), 1.0)]).select(F.col("event_id").alias("other_id"), "user_id", F.col("ts").alias("other_ts"))
    pairs = streaming.interval_pairs(left, right, "user_id", "ts", "other_ts", "10 minutes", "1 hour")
    assert [(r.event_id, r.other_id) for r in streaming.run_available(pairs, f"{tmp_path}/p", f"{tmp_path}/ps").collect()] == [(1, 3)]


def test_type_changes_carry_over_batches(spark, tmp_path):
    kinds = ["a", "a", "b", "b", "a", "c"]
    schema = "event_id long, user_id long, ts timestamp_ntz, kind string"
    for k in (0, 1):
        rows = [(i, 1, at(i), kinds[i]) for i in range(3 * k, 3 * k + 3)] + [(9, 2 + k, at(9), "z")]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    stream = files.stream(spark, f"{tmp_path}/in/*", schema, files_per_batch=1)
    with streaming.rocksdb(spark):
        out = streaming.run_available(streaming.type_changes(stream, "user_id", ["ts"], "kind"), f"{tmp_path}/o", f"{tmp_path}/s", "update")
    assert {r.user_id: r.c for r in out.groupBy("user_id").agg(F.max("changes").alias("c")).collect()} == {1: 3, 2: 0, 3: 0}


def test_running_totals(spark, tmp_path):
    stream = dropped(spark, f"{tmp_path}/in", [(1, 1, at(0), 2.0), (2, 2, at(0), 1.0)], [(3, 1, at(5), 5.0), (4, 1, at(6), None)])
    seen = {}
    query = streaming.running_totals(stream, "user_id", "value").writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True)
    query.foreachBatch(lambda batch, _: seen.update({r.user_id: (r.n, r.total, r.top) for r in batch.collect()})).start().awaitTermination()
    assert seen == {1: (2, 7.0, 5.0), 2: (1, 1.0, 1.0)}
