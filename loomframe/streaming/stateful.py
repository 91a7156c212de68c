"""Keyed state of arbitrary shape, in Arrow batches."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_totals(events: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, total, top) of a key after each batch that touches it; the state is three numbers a key."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, top = state.get if state.exists else (0, 0.0, float("-inf"))
        for batch in batches:
            values = batch[value].dropna()
            n, total = n + len(values), total + float(values.sum())
            top = max(top, float(values.max())) if len(values) else top
        state.update((n, total, top))
        yield pd.DataFrame({by: [key[0]], "n": [n], "total": [total], "top": [top]})

    kind = dict(events.dtypes)[by]
    out = events.select(by, value).groupBy(by)
    return out.applyInPandasWithState(update, f"{by} {kind}, n long, total double, top double", "n long, total double, top double", "update", GroupStateTimeout.NoTimeout)


@contextlib.contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Within it, streams that start keep their state in RocksDB, as transformWithState needs."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def type_changes(events: DataFrame, by: str, order: list[str], kind: str) -> DataFrame:
    """(by, changes) after each batch: how often a key's kind differed from the one before; a batch's rows are put in order."""

    class Changes(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.last = handle.getValueState("last", "kind string, changes long")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            kinds = pd.concat(list(rows)).sort_values(order)[kind].tolist()
            before, changes = self.last.get() if self.last.exists() else (kinds[0], 0)
            for now in kinds:
                changes, before = changes + (now != before), now
            self.last.update((before, changes))
            yield pd.DataFrame({by: [key[0]], "changes": [changes]})

        def close(self) -> None:
            pass

    out = events.select(by, *order, kind).groupBy(by)
    return out.transformWithStateInPandas(Changes(), f"{by} {dict(events.dtypes)[by]}, changes long", "update", "none")


def timed_sessions(events: DataFrame, by: str, ts: str, kind: str, gap: str, late: str) -> DataFrame:
    """(by, opened, closed, n, kinds) of sessions that end after `gap` without an event, by a timer of the watermark's time.

    The state is a key's sessions that the watermark hasn't passed: of each its ends, its number, and a map of how often
    it had each kind. A row joins the sessions that it is less than `gap` from, whatever order rows come in; a session
    is given once the watermark, which counts milliseconds, is at its end, even if a later row has opened
    another one. Rows behind the watermark are left out, and those without a key or time.
    """
    micros = pd.Timedelta(gap).value // 1000

    def timer(sessions: list) -> int | None:
        # timers before the watermark expire: this one does if the first end is at it or before
        return -(-(min(last for _, last, _, _ in sessions) + micros) // 1000) - 1 if sessions else None

    class Sessions(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.open = handle.getValueState("open", "sessions array<struct<opened: long, last: long, n: long, kinds: map<string, long>>>")

        def kept(self) -> list:
            return [tuple(s) for s in self.open.get()[0]] if self.open.exists() else []

        def keep(self, sessions: list, before: int | None) -> None:
            """The sessions as the state, and their timer instead of the one before."""
            if sessions:
                self.open.update((sessions,))
            else:
                self.open.clear()
            if (now := timer(sessions)) != before:
                if before is not None:
                    self.handle.deleteTimer(before)
                if now is not None:
                    self.handle.registerTimer(now)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            sessions = self.kept()
            before = timer(sessions)
            for frame in rows:
                new = [(at, at, 1, {} if what is None else {what: 1}) for at, what in zip(frame["event_micros"].tolist(), frame[kind].tolist())]
                merged: list = []
                for opened, last, n, kinds in sorted(sessions + new, key=lambda s: s[0]):
                    if merged and opened - merged[-1][1] < micros:
                        first, end, m, held = merged[-1]
                        merged[-1] = (first, max(end, last), m + n, held | {k: held.get(k, 0) + v for k, v in kinds.items()})
                    else:
                        merged.append((opened, last, n, kinds))
                sessions = merged
            self.keep(sessions, before)
            yield from ()

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            sessions = self.kept()
            passed = 1000 * max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1)
            # the timer that expired is deleted by Spark
            self.keep([s for s in sessions if s[1] + micros > passed], None)
            if ended := [s for s in sessions if s[1] + micros <= passed]:
                named = [",".join(f"{k}:{v}" for k, v in sorted(kinds.items())) or None for _, _, _, kinds in ended]
                yield pd.DataFrame({by: key[0], "opened": [s[0] for s in ended], "closed": [s[1] + micros for s in ended], "n": [s[2] for s in ended], "kinds": named})

        def close(self) -> None:
            pass

    rows = events.where(F.col(by).isNotNull() & F.col(ts).isNotNull()).select(by, F.col(ts).cast("timestamp").alias(ts), kind).withWatermark(ts, late)
    schema = f"{by} {dict(events.dtypes)[by]}, opened long, closed long, n long, kinds string"
    found = rows.withColumn("event_micros", F.unix_micros(ts)).groupBy(by).transformWithStateInPandas(Sessions(), schema, "append", "eventTime")
    return found.withColumns({c: F.timestamp_micros(c) for c in ("opened", "closed")})
