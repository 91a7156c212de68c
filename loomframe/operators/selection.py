"""Exact quantiles and medians of groups that no task could hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.operators.ranges import numbered


def quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float], discrete: bool = False) -> DataFrame:
    """(by, one column for each of `at`): the values at these fractions of each group's order, nulls left out.

    Between two rows by linear interpolation, as doubles; `discrete` takes the first value whose share of the rows
    reaches the fraction. Groups of nulls alone have nulls.

    Equal values are counted first, which combines in the tasks; distinct ones are then range-sorted with their counts, so
    each knows the places that it stands for, and the one or two values at each fraction are picked by an
    aggregation of constant size. No group's values meet in a buffer, and a hot group is spread over partitions.
    """
    col = F.col(f"`{value}`")
    counts = df.where(col.isNotNull()).groupBy(*by, col.alias("_value")).agg(F.count(F.lit(1)).alias("_weight"))
    rows = numbered(counts, by, ["_value"], weight="_weight")
    last = F.col("_at") + F.col("_weight") - 1
    held = lambda place: (F.col("_at") <= place) & (last >= place)
    picks: dict[str, Column] = {}
    for name, share in at.items():
        if discrete:
            picks[name] = F.min(F.when(held(F.greatest(F.ceil(F.lit(share) * F.col("_n")) - 1, F.lit(0))), F.col("_value")))
        else:
            # max: each place is held by one value
            exact = F.lit(float(share)) * (F.col("_n") - 1)
            low = F.max(F.when(held(F.floor(exact)), F.col("_value").cast("double")))
            high = F.max(F.when(held(F.ceil(exact)), F.col("_value").cast("double")))
            part = F.max(exact - F.floor(exact))
            picks[name] = F.when(low == high, low).otherwise(low * (1 - part) + high * part)
    found = rows.groupBy(*by).agg(*[c.alias(name) for name, c in picks.items()])
    if not by:
        return found
    keys = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    same = [keys[f"`{c}`"].eqNullSafe(found[f"`{c}`"]) for c in by]
    return keys.join(found, same, "left").select(*[keys[f"`{c}`"] for c in by], *[found[f"`{name}`"] for name in at])
