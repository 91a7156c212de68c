"""Tables that an operator writes on the way: they cut lineage, survive lost executors and keep a sort's partitions."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession

from loomframe.session import shared_dir

#: What is to be deleted when the process ends, as results are read lazily: path -> session.
_LEFT: dict[str, SparkSession] = {}


def temporary(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, for what is deleted when the process ends."""
    if not _LEFT:
        # before the session's own end, as it was registered later
        atexit.register(_clear)
    path = f"{shared_dir(spark)}/stages/{name}-{uuid.uuid4().hex}"
    _LEFT[path] = spark
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """df as a written table in the shared folder; deleted by `unstage`, or when the process ends."""
    path = temporary(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for table in tables:
        for path in {p for p in _LEFT for file in table.inputFiles() if p.rsplit("/", 1)[1] in file}:
            _delete(path)


def _delete(path: str) -> None:
    spark = _LEFT.pop(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _clear() -> None:
    for path in list(_LEFT):
        with contextlib.suppress(Exception):  # the session may have ended
            _delete(path)
