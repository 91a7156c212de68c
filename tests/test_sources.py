import pytest
from pyspark.sql import functions as F

from loomframe.session import SETTINGS
from loomframe.sources import TABLES, number_rows, read, read_table, register_views, write, write_bucketed

ROWS = [(1, "a", 0.5), (2, "b", None), (3, None, -1.0)]
SCHEMA = "k int, s string, x double"


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_round_trip(spark, tmp_path, kind):
    df = spark.createDataFrame(ROWS, SCHEMA)
    write(df, f"{tmp_path}/out", kind)
    assert sorted(map(tuple, read(spark, f"{tmp_path}/out", kind, SCHEMA).collect())) == ROWS


def test_partitioned_and_checked(spark, tmp_path):
    write(spark.createDataFrame(ROWS, SCHEMA), f"{tmp_path}/p", partition_by=("k",))
    back = read(spark, f"{tmp_path}/p").where("k = 2")
    assert back.count() == 1 and "PartitionFilters: [isnotnull(k" in back._jdf.queryExecution().executedPlan().toString()
    for bad in (lambda: read(spark, "x", "csv"), lambda: read(spark, "x", "nope"), lambda: write(back, "x", "nope")):
        with pytest.raises(ValueError):
            bad()


def test_bucketed_join_needs_no_shuffle(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    write_bucketed(df, "bucketed_a", ("k",), 4)
    write_bucketed(df, "bucketed_b", ("k",), 4)
    joined = spark.table("bucketed_a").hint("merge").join(spark.table("bucketed_b"), "k")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 1000


def test_numbers_source(spark):
    got = number_rows(spark, -3, 11, 4)
    assert sorted(r.n for r in got.collect()) == list(range(-3, 12)) and got.rdd.getNumPartitions() == 4
    assert number_rows(spark, 5, 4, 3).collect() == [] and number_rows(spark, 1, 1, 9).count() == 1


def test_a_rewritten_table_is_read_with_its_own_schema(spark, tmp_path):
    for df in (spark.range(3), spark.range(3).select(F.col("id").cast("string").alias("name"), "id")):
        df.write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
        assert read_table(spark, str(tmp_path), "t").columns == df.columns


def test_tables(spark, sf_dir):
    register_views(spark, sf_dir, TABLES)
    assert all(spark.table(t).count() == read_table(spark, sf_dir, t).count() for t in ("region", "nation"))
    assert SETTINGS["spark.sql.adaptive.enabled"] == "true"


def test_staged_tables_go(spark):
    import glob

    from loomframe.session import shared_dir
    from loomframe.sources import stages

    top = shared_dir(spark).removeprefix("file://")
    one, two = (stages.stage(spark.range(k), "some") for k in (3, 4))
    assert one.count() == 3 and len(glob.glob(f"{top}/stages/some-*")) == 2
    stages.unstage(one)
    assert len(glob.glob(f"{top}/stages/some-*")) == 1 and two.count() == 4
    stages.unstage(two)
    assert glob.glob(f"{top}/stages/some-*") == []
