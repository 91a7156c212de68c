"""File formats: readers with declared schemas, partitioned and bucketed writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = ("parquet", "orc", "json", "csv", "text", "xml")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: StructType | str | None = None, **options: str) -> DataFrame:
    """A file or folder; csv, json and xml want a schema, so that no pass is spent on inferring one."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    if schema is None and kind in ("csv", "json", "xml"):
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists", **options: str) -> None:
    """Rows of a partition value are brought together first, so that each value has few files."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    if partition_by:
        df = df.repartition(*partition_by)
    df.write.format(kind).options(**options).mode(mode).partitionBy(*partition_by).save(path)


def write_bucketed(df: DataFrame, table: str, keys: tuple[str, ...], buckets: int, mode: str = "overwrite") -> None:
    """A table whose joins and groupings on the keys need no shuffle."""
    df.write.mode(mode).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)


def stream(spark: SparkSession, path: str, schema: StructType | str, kind: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)
