"""Shared plumbing: written intermediates, word splitting, grouped streaming over sorted partitions."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.session import shared_dir

#: One or more of the white space code points that separate words: space, \t \n \v \f \r.
SPACE = r"[\x20\x09-\x0D]+"


#: Rows of whole texts in an Arrow batch: of Spark's 10000, a few batches in flight fill an executor's memory.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
#: In force while a query is written; shuffle files go when it ends instead of when the driver collects garbage.
LEAN = BATCH | {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def small_batches(spark: SparkSession) -> None:
    """From now on BATCH holds in this session, for results that are read later."""
    for k, v in BATCH.items():
        spark.conf.set(k, v)


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within it, LEAN holds."""
    before = {k: spark.conf.get(k, None) for k in LEAN}
    for k, v in LEAN.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Owners of written tables, the innermost last.
_OWNERS: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """An owner of what is written within it: at its end, those tables are deleted. Results that read them
    must be written by then, outside or as `kept`."""
    _OWNERS.append([])
    try:
        yield
    finally:
        for path in _OWNERS.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """written, but no scratch's."""
    owners = _OWNERS[:]
    _OWNERS.clear()
    try:
        return written(df, name)
    finally:
        _OWNERS[:] = owners


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, prunes columns."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomframe/{name}-{uuid.uuid4().hex}"
    if _OWNERS:
        _OWNERS[-1].append(path)
    with tidy(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete written intermediates that nothing reads any more."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            folder = file.rsplit("/", 1)[0]
            if "/loomframe/" in folder:
                delete(table.sparkSession, folder)


def words_of(text: Column) -> Column:
    """array<string> of the words of a text; null text: null."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(offsets, words): the words of text i are words[offsets[i]:offsets[i + 1]]. Null: none."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    if isinstance(parts, pa.ChunkedArray):
        parts = parts.combine_chunks()
    offsets = np.asarray(parts.offsets).astype(np.int64)
    words = parts.values
    full = np.asarray(pc.greater(pc.binary_length(words), 0))
    upto = np.concatenate([[0], np.cumsum(full)])
    return upto[offsets] - upto[offsets[0]], words.slice(offsets[0], offsets[-1] - offsets[0]).filter(pa.array(full[offsets[0] : offsets[-1]]))


#: What workers remember between tasks, by operator: how to forget it.
REMEMBERED: dict[str, Callable[[], None]] = {}


def given_back() -> None:
    """Return a worker's freed memory to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 2 << 20, keep: str = "") -> Iterator[pa.RecordBatch]:
    """The batches cut so that a piece holds about most_bytes of the column, and one row at least.

    A worker forgets what other operators than `keep` have it remember.
    """
    for name, forget in REMEMBERED.items():
        if name != keep:
            forget()
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        upto, at = np.cumsum(np.asarray(size).astype(np.int64)), 0
        while at < batch.num_rows:
            base = upto[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(upto, base + most_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to
    given_back()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply), vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def by_group(keys: list[str], schema: pa.Schema, work: Callable[[pa.Table], Iterator[pa.RecordBatch] | None]):
    """A mapInArrow function over partitions sorted by keys: calls work once for each group, holding one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def flush():
            group = pa.Table.from_batches(held)
            yield from work(group) or ()

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            for col in cols:
                if len(col) > 1:
                    same = pc.equal(col.slice(1), col.slice(0, len(col) - 1))
                    change[1:] |= ~np.asarray(pc.fill_null(same, False))
            cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                key = tuple(c[lo].as_py() for c in cols)
                if held and key != last:
                    yield from flush()
                    held.clear()
                last = key
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from flush()

    return run
