"""Text columns as rows, in the JVM."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tokens(df: DataFrame, keep: list[str], text: str) -> DataFrame:
    """keep with place and token: a row for each lower-case a-z word of a text."""
    words = F.filter(F.split(F.lower(F.col(text)), "[^a-z]+"), lambda w: w != "")
    return df.select(*keep, F.posexplode(words).alias("place", "token"))
