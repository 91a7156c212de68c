"""The star-schema tables, read lazily so that Catalyst prunes columns and pushes filters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


#: By path: what the store says of its files, and their schema, so that reading a table again needs no job over footers.
_SCHEMAS: dict[str, tuple[str, StructType]] = {}


def _status(spark: SparkSession, path: str) -> str:
    """Names, lengths and times of the files at a path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return re.sub(r"access_time=\d+", "", "\n".join(file.toString() for file in found))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """`{sf_dir}/{name}.parquet`, a file or a folder of part files, in any store Spark reads."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    status = _status(spark, path)
    if path not in _SCHEMAS or _SCHEMAS[path][0] != status:
        _SCHEMAS[path] = (status, spark.read.parquet(path).schema)
    return spark.read.schema(_SCHEMAS[path][1]).parquet(path)


def register_views(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> None:
    """Temporary views over the named tables for plans written in SQL."""
    for name in names:
        read_table(spark, sf_dir, name).createOrReplaceTempView(name)
