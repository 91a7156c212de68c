import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
from compare import assert_same, connect  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

from loomframe.plans import catalog, extended  # noqa: E402


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_equals_duckdb(spark, sf_dir, con, name):
    assert_same(catalog.QUERIES[name](spark, sf_dir), con, catalog.SQL[name])


def test_every_query_has_sql_and_entry_runs(spark):
    assert set(catalog.QUERIES) == set(catalog.SQL) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned_and_pushed(spark, sf_dir):
    plan = plan_of(catalog.QUERIES["q6_filter_sum"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(l_discount), IsNotNull(l_quantity)" in plan and "l_comment" not in plan and "l_tax" not in plan


def test_buckets_spare_the_shuffle(spark, sf_dir):
    found, names = extended.joined_buckets(spark, sf_dir)
    plan = plan_of(found)
    for name in names:
        spark.sql(f"drop table {name}")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_hints_are_obeyed(spark, sf_dir):
    plan = plan_of(catalog.QUERIES["join_hints"](spark, sf_dir))
    assert "SortMergeJoin" in plan and "ShuffledHashJoin" in plan


@pytest.mark.parametrize("name", ["kll_sketches", "approximate_percentiles"])
def test_sketches_are_compared_without_a_buffer_of_all_values(spark, sf_dir, name):
    assert " percentile(" not in plan_of(catalog.QUERIES[name](spark, sf_dir)).replace("partial_", " ").replace("[", " ")


def test_kll_of_ties_and_nulls(spark, sf_dir, tmp_path):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    for k, price in enumerate((F.lit(7.0), F.when(F.col("l_linenumber") > 2, F.col("l_quantity")))):
        lines.withColumn("l_extendedprice", price).write.parquet(f"{tmp_path}/{k}/lineitem.parquet")
        assert [r.near for r in catalog.QUERIES["kll_sketches"](spark, f"{tmp_path}/{k}").collect()] == [True]


def test_overflow_throws_for_no_row(spark, sf_dir, tmp_path):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").limit(5).drop("l_linenumber")
    numbers = spark.createDataFrame([(-3,), (0,), (1,), (9,), (None,)], "l_linenumber int")
    lines.limit(1).crossJoin(numbers).select(*spark.read.parquet(f"{sf_dir}/lineitem.parquet").columns).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalog.QUERIES["safe_arithmetic"](spark, str(tmp_path))
    assert {r.l_linenumber: r.over for r in found.collect()} == {-3: False, 0: False, 1: True, 9: True, None: True}
    assert "(l_linenumber" in plan_of(found).split(" > 0)")[0] and " > 0)" in plan_of(found)


def test_sorted_within_partitions(spark, sf_dir):
    rows = catalog.QUERIES["sorted_within"](spark, sf_dir).withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}).orderBy("row").collect()
    keys = {}
    for r in rows:
        keys.setdefault(r.part, []).append((r.o_custkey, r.o_orderkey))
    assert all(own == sorted(own) for own in keys.values()) and len({(k, p) for p, own in keys.items() for k, _ in own}) == len({k for own in keys.values() for k, _ in own})


def test_no_cartesian_products(spark, sf_dir):
    for name in sorted(q for q in catalog.QUERIES if q not in ("theta_join", "cross_join") and not q.startswith("stream_")):
        assert "CartesianProduct" not in plan_of(catalog.QUERIES[name](spark, sf_dir)), name
