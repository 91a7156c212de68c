"""A custom data source: rows of consecutive numbers, read by partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Numbers(DataSource):
    """Options first, last and partitions; a column n."""

    @classmethod
    def name(cls) -> str:
        return "loomframe_numbers"

    def schema(self) -> str:
        return "n long"

    def reader(self, schema) -> DataSourceReader:
        return NumbersReader(int(self.options["first"]), int(self.options["last"]), int(self.options["partitions"]))


class Span(InputPartition):
    def __init__(self, lo: int, hi: int) -> None:
        self.lo, self.hi = lo, hi


class NumbersReader(DataSourceReader):
    def __init__(self, first: int, last: int, parts: int) -> None:
        self.first, self.last, self.parts = first, last, parts

    def partitions(self) -> list[Span]:
        n = self.last - self.first + 1
        cuts = [self.first + n * k // self.parts for k in range(self.parts + 1)]
        return [Span(lo, hi) for lo, hi in zip(cuts, cuts[1:]) if lo < hi] or [Span(0, 0)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        for at in range(span.lo, span.hi, 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(range(at, min(at + (1 << 16), span.hi)), pa.int64())], ["n"])


def number_rows(spark: SparkSession, first: int, last: int, partitions: int) -> DataFrame:
    """first to last, both included."""
    spark.dataSource.register(Numbers)
    return spark.read.format("loomframe_numbers").options(first=str(first), last=str(last), partitions=str(partitions)).load()
