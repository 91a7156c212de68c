"""Aggregates of one's own whose states merge: partial in each task, then by key."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Keys that a task holds states for before it hands them on.
MOST_KEYS = 10_000


class Aggregate(Protocol):
    """State by state: of a batch's column, two merged, and the results (a value for each column of `schema`)."""

    schema: str

    def state(self, values: pa.Array) -> Any: ...

    def merged(self, one: Any, other: Any) -> Any: ...

    def result(self, state: Any) -> tuple: ...


def aggregated(df: DataFrame, by: str, value: str, how: Aggregate, fan_in: int = 64) -> DataFrame:
    """(by, results of `how`) of each key; null keys are a key.

    A task keeps one state for each of its keys, so it hands on as many rows as it has keys, however hot one is. States
    of a key are merged in two steps, first `fan_in` groups of it and then those, so that no task merges all partitions'.
    """

    kind = df.schema[by]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[Any, Any] = {}

        def told() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array(list(states), batch_type), pa.array([pickle.dumps(s) for s in states.values()], pa.binary())], [by, "_state"])
            states.clear()

        batch_type = None
        for batch in batches:
            batch_type = batch.schema.field(by).type
            keys = batch.column(by).dictionary_encode(null_encoding="encode")
            order = pc.array_sort_indices(keys.indices)
            which = np.asarray(keys.indices.take(order))
            cuts = [0, *(np.flatnonzero(np.diff(which)) + 1).tolist(), len(which)]
            values = batch.column(value).take(order)
            for lo, hi in zip(cuts, cuts[1:]):
                if lo < hi:
                    key, new = keys.dictionary[int(which[lo])].as_py(), how.state(values.slice(lo, hi - lo))
                    states[key] = how.merged(states[key], new) if key in states else new
            if len(states) > MOST_KEYS:
                yield from told()
        if states:
            yield from told()

    def merge(frame: pd.DataFrame) -> Any:
        states = [pickle.loads(s) for s in frame["_state"]]
        whole = states[0]
        for s in states[1:]:
            whole = how.merged(whole, s)
        return whole

    def some(_: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({by: frame[by].iloc[:1].to_numpy(), "_state": [pickle.dumps(merge(frame))]})

    results = StructType.fromDDL(how.schema)

    def last(_: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found = how.result(merge(frame))
        return pd.DataFrame({by: frame[by].iloc[:1].to_numpy(), **{name: [x] for name, x in zip(results.names, found)}})

    parts = df.select(by, value).mapInArrow(partial, StructType([kind]).add("_state", "binary"))
    parts = parts.withColumn("_group", F.pmod(F.spark_partition_id(), F.lit(fan_in)))
    parts = parts.groupBy(by, "_group").applyInPandas(some, StructType([kind]).add("_state", "binary"))
    return parts.groupBy(by).applyInPandas(last, StructType([kind, *results.fields]))


class Spread:
    """How vectors of one length scatter: their number, total variance (the covariance matrix's trace) and effective
    dimension, (trace C)^2 / trace(C^2), from 1 (a line) to the number of components (a ball). Null vectors and those with
    null or not finite components are left out; with one vector or equal ones only, the dimension is null.

    The state is the number, the means and the matrix of co-moments; two are merged without a second look at the rows.
    """

    schema = "n long, variance double, dimension double"

    def __init__(self, components: int) -> None:
        self.components = components

    def state(self, values: pa.Array) -> tuple[int, np.ndarray, np.ndarray]:
        values = values.filter(pc.fill_null(pc.equal(pc.list_value_length(values), self.components), False))
        rows = values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, self.components)
        rows = rows[np.isfinite(rows).all(axis=1)]
        n = len(rows)
        mean = rows.mean(axis=0) if n else np.zeros(self.components)
        away = rows - mean
        return n, mean, away.T @ away

    def merged(self, one, other):
        (n, a, x), (m, b, y) = one, other
        if not n or not m:
            return one if n else other
        apart = b - a
        return n + m, a + apart * (m / (n + m)), x + y + np.outer(apart, apart) * (n * m / (n + m))

    def result(self, state) -> tuple:
        n, _, moments = state
        if n < 2:
            return n, None, None
        c = moments / (n - 1)
        trace, square = float(np.trace(c)), float((c * c).sum())
        return n, trace, trace * trace / square if square > 0 else None
