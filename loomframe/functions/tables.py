"""Table functions: rows of a table argument, by key and in order, with what is kept between rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, Row, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn


class Thinned:
    """Of each key the rows that are at least `gap` seconds after the last one that was kept; the first is kept.

    Which rows stay depends on which stayed before, so no window expresses it. Arguments: a table, the names of its key,
    of its time and of what settles ties (text literals), and the gap. The function itself asks for the partitioning
    and order that it needs. Rows with a null time are left out; null keys are a key.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, ts: AnalyzeArgument, ties: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable:
            raise ValueError("the first argument must be a table")
        names = table.dataType.fieldNames()
        for given in (key, ts, ties):
            if given.value not in names:
                raise ValueError(f"the table has no column {given.value}")
        if gap.value is None or gap.value < 0:
            raise ValueError("the gap must be a number of seconds")
        schema = StructType([*table.dataType.fields, StructField("kept_no", LongType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(ts.value), OrderingColumn(ties.value)])

    def __init__(self) -> None:
        self.last, self.n = None, 0

    def eval(self, row: Row, key: str, ts: str, ties: str, gap: float) -> Iterator[tuple]:
        now = row[ts]
        if now is not None and (self.last is None or (now - self.last).total_seconds() >= gap):
            self.last, self.n = now, self.n + 1
            yield (*row, self.n)


def thinned(df: DataFrame, key: str, ts: str, ties: str, gap: float) -> DataFrame:
    """df's rows that Thinned keeps, with `kept_no`, their number in the key; one key's rows pass through one task in order."""
    function = F.udtf(Thinned)
    spark = df.sparkSession
    spark.udtf.register("loomframe_thinned", function)
    return spark.sql("select * from loomframe_thinned(table({rows}), {key}, {ts}, {ties}, {gap})".replace("{key}", f"'{key}'").replace("{ts}", f"'{ts}'").replace("{ties}", f"'{ties}'").replace("{gap}", f"{float(gap)}D"), rows=df)
