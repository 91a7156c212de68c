"""Tables replayed as streams of files, in the order and lateness that one wants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.sources.files import stream
from loomframe.sources.stages import temporary


def replay(df: DataFrame, slice_of: Column, slices: int, late: Column | None = None, by: int = 0, files: int = 2) -> DataFrame:
    """A stream of df in `slices` batches: rows of slice 0 first, and so on; `late` rows come `by` slices after their own,
    if there are so many. A slice is written as `files` files, after those before it, and read as one batch."""
    spark = df.sparkSession
    path = temporary(spark, "replayed")
    own = slice_of.cast("int")
    arrives = own if late is None else F.when(late & (own + by < slices), own + by).otherwise(own)
    rows = df.withColumn("_slice", arrives)
    for k in range(slices):
        rows.where(F.col("_slice") == k).drop("_slice").repartition(files).write.mode("append").parquet(path)
    return stream(spark, path, df.schema, files_per_batch=files)
