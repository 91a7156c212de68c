"""User-defined functions where Spark has no function: scalar, grouped, cogrouped and by partition, in Arrow batches."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nfc(text: Column) -> Column:
    """Unicode normal form C of a text, a scalar function over batches."""

    @F.pandas_udf("string")
    def normal(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return normal(text)


def code_points(text: Column) -> Column:
    """How many code points a text has, a scalar function over Arrow arrays."""

    @F.arrow_udf("long")
    def counted(values: pa.Array) -> pa.Array:
        return pc.utf8_length(values).cast(pa.int64())

    return counted(text)


def extracted(df: DataFrame, key: str, text: str, pattern: str, name: str) -> DataFrame:
    """(key, name): what the pattern's group finds first in each text, by partition in pandas; null if nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = batch[text].str.extract(pattern, expand=False)
            yield pd.DataFrame({key: batch[key], name: found.astype(object).where(found.notna(), None)})

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, {name} string")


def moving_averages(df: DataFrame, key: str, order: list[str], value: str, weight: float) -> DataFrame:
    """(key, ema): the exponential moving average at each key's last row; a key's rows meet in one worker."""

    def last(rows: pd.DataFrame) -> pd.DataFrame:
        values = rows.sort_values(order)[value]
        return pd.DataFrame({key: rows[key].iloc[:1].to_numpy(), "ema": values.ewm(alpha=weight, adjust=False).mean().iloc[-1:].to_numpy()})

    return df.groupBy(key).applyInPandas(last, f"{key} {dict(df.dtypes)[key]}, ema double")


def cogrouped_asof(left: DataFrame, right: DataFrame, key: str, on: str, value: str) -> DataFrame:
    """Each left row with the value of the last right row of its key at or before it; for keys whose rows
    fit in a worker, see operators.asof_join for others."""

    def match(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty:
            return pd.DataFrame(columns=[*left_names, value])
        if b.empty:
            return a.assign(**{value: pd.array([None] * len(a), "Int64")})
        found = pd.merge_asof(a.sort_values(on), b[["_on", value]].sort_values(["_on", value]), left_on=on, right_on="_on").drop(columns="_on")
        found[value] = found[value].astype("Int64")
        return found

    kinds, left_names = dict(right.dtypes), left.columns
    schema = ", ".join([f"{n} {t}" for n, t in left.dtypes] + [f"{value} {kinds[value]}"])
    # Names of its own keep the sides apart when both come from one table.
    other = right.select(F.col(key).alias("_key"), F.col(on).alias("_on"), value)
    return left.groupBy(key).cogroup(other.groupBy("_key")).applyInPandas(match, schema)


def word_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_words) of whole texts, by partition; words are set apart by ASCII white space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trimmed = pc.ascii_trim_whitespace(pc.fill_null(batch.column(text), ""))
            n = pc.if_else(pc.equal(trimmed, ""), 0, pc.list_value_length(pc.ascii_split_whitespace(trimmed)))
            yield pa.RecordBatch.from_arrays([batch.column(key), n.cast(pa.int64())], [key, "n_words"])

    return df.select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, n_words long")
