"""A data source of Parquet files with commits: pushed filters, a stream of commits, and a writer that leaves nothing half done.

A table is a folder with `data/`, a file for each writing task, and `commits/`, numbered records of the files that belong to
it. Readers see only files that a record names, so what a failed or running write has left is never read. A commit is one
rename of a record that is already whole. Of a plain Parquet file or folder without commits all files are read.

Files are reached by Arrow's file systems, so a path may be local to a shared mount, or have a scheme that Arrow knows. A
partition is a row group; those whose statistics exclude the pushed filters are not read. The filters are applied to
what is read, and Spark applies those that can't be pushed. Writes by two jobs at once need a lock of one's own.
"""

from __future__ import annotations

import functools
import json
import operator
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

NAME = "loomframe_committed"
COMPARED = {D.EqualTo: operator.eq, D.GreaterThan: operator.gt, D.GreaterThanOrEqual: operator.ge, D.LessThan: operator.lt, D.LessThanOrEqual: operator.le}


def located(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def listed(fs: pafs.FileSystem, folder: str, ending: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and f.base_name.endswith(ending) and not f.base_name.startswith(("_", ".")))


def files_of(path: str, after: int = -1, upto: int | None = None) -> list[str]:
    """Files of the commits with numbers above `after` up to `upto`, or all of a plain file or folder."""
    fs, root = located(path)
    if fs.get_file_info(f"{root}/commits").type == pafs.FileType.NotFound:
        return listed(fs, root, ".parquet") if fs.get_file_info(root).type == pafs.FileType.Directory else [root]
    files: list[str] = []
    for record in listed(fs, f"{root}/commits", ".json"):
        number = int(record.rsplit("/", 1)[1].split(".")[0])
        if after < number and (upto is None or number <= upto):
            with fs.open_input_file(record) as file:
                files += [f"{root}/data/{f['file']}" for f in json.loads(file.read())]
    return files


def last_commit(path: str) -> int:
    fs, root = located(path)
    records = listed(fs, f"{root}/commits", ".json")
    return int(records[-1].rsplit("/", 1)[1].split(".")[0]) if records else -1


@dataclass
class RowGroup(D.InputPartition):
    file: str
    group: int


@dataclass
class Written(D.WriterCommitMessage):
    file: str
    rows: int


def expression(given: D.Filter) -> pc.Expression | None:
    """A filter for Arrow, or None if it isn't one of those that are pushed."""
    if len(getattr(given, "attribute", ())) != 1:
        return None
    field = ds.field(given.attribute[0])
    if type(given) in COMPARED:
        return COMPARED[type(given)](field, given.value)
    if isinstance(given, D.In):
        return field.isin(list(given.value))
    if isinstance(given, D.IsNotNull):
        return field.is_valid()
    return None


class Reads:
    """What the batch and the stream reader have in common."""

    def __init__(self, path: str) -> None:
        self.path, self.filters = path, []

    def groups(self, files: list[str]) -> list[RowGroup]:
        fs, _ = located(self.path)
        where = self.where()
        found = []
        for file in files:
            fragment = ds.ParquetFileFormat().make_fragment(file, fs)
            found += [RowGroup(file, g.row_groups[0].id) for g in fragment.split_by_row_group(where)]
        return found

    def where(self) -> pc.Expression | None:
        return functools.reduce(operator.and_, self.filters) if self.filters else None

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        fs, _ = located(self.path)
        fragment = ds.ParquetFileFormat().make_fragment(partition.file, fs, row_groups=[partition.group])
        for batch in fragment.to_batches(filter=self.where(), batch_size=1 << 15):
            if batch.num_rows:
                yield batch


class Reader(Reads, D.DataSourceReader):
    def pushFilters(self, filters: list[D.Filter]) -> Iterable[D.Filter]:
        for given in filters:
            made = expression(given)
            if made is None:
                yield given
            else:
                self.filters.append(made)

    def partitions(self) -> list[RowGroup]:
        # Spark wants one partition at least
        return self.groups(files_of(self.path)) or [RowGroup("", -1)]

    def read(self, partition: RowGroup) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition.group < 0 else super().read(partition)


class StreamReader(Reads, D.DataSourceStreamReader):
    """Offsets are numbers of commits."""

    def initialOffset(self) -> dict:
        return {"commit": -1}

    def latestOffset(self) -> dict:
        return {"commit": last_commit(self.path)}

    def partitions(self, start: dict, end: dict) -> list[RowGroup]:
        return self.groups(files_of(self.path, start["commit"], end["commit"]))


class Writer(D.DataSourceArrowWriter):
    def __init__(self, path: str, schema: pa.Schema, overwrite: bool) -> None:
        self.path, self.schema, self.overwrite = path, schema, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = located(self.path)
        name, rows = f"{uuid.uuid4().hex}.parquet", 0
        fs.create_dir(f"{root}/data", recursive=True)
        try:
            with fs.open_output_stream(f"{root}/data/{name}") as sink, pq.ParquetWriter(sink, self.schema) as out:
                for batch in iterator:
                    out.write_batch(batch.cast(self.schema))
                    rows += batch.num_rows
        except BaseException:
            fs.delete_file(f"{root}/data/{name}")
            raise
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = located(self.path)
        fs.create_dir(f"{root}/commits", recursive=True)
        number = last_commit(self.path) + 1
        before = listed(fs, f"{root}/commits", ".json") if self.overwrite else []
        draft = f"{root}/commits/_{uuid.uuid4().hex}"
        with fs.open_output_stream(draft) as out:
            out.write(json.dumps([{"file": m.file, "rows": m.rows} for m in messages if m is not None and m.rows]).encode())
        fs.move(draft, f"{root}/commits/{number:012d}.json")
        for old in before:
            fs.delete_file(old)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = located(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(f"{root}/data/{m.file}")


class Committed(D.DataSource):
    """Option path."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self):
        files = files_of(self.options["path"])
        if not files:
            raise ValueError(f"{self.options['path']} has no files")
        fs, _ = located(self.options["path"])
        return from_arrow_schema(pq.read_schema(files[0], filesystem=fs), prefer_timestamp_ntz=True)

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], to_arrow_schema(schema), overwrite)


def _registered(spark: SparkSession) -> None:
    spark.dataSource.register(Committed)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """A committed table, or a plain Parquet file or folder; filters are pushed."""
    _registered(spark)
    return spark.read.format(NAME).option("path", path).load()


def stream_committed(spark: SparkSession, path: str) -> DataFrame:
    """The commits of a table as a stream."""
    _registered(spark)
    return spark.readStream.format(NAME).option("path", path).load()


def write_committed(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One more commit, or one in place of all."""
    _registered(df.sparkSession)
    df.write.format(NAME).option("path", path).mode("overwrite" if overwrite else "append").save()
