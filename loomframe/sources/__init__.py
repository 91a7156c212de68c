"""Readers and writers."""

from loomframe.sources.committed import read_committed, stream_committed, write_committed
from loomframe.sources.files import read, stream, write, write_bucketed
from loomframe.sources.numbers import number_rows
from loomframe.sources.replay import replay
from loomframe.sources.tables import TABLES, read_table, register_views

__all__ = [
    "TABLES", "number_rows", "read", "read_committed", "read_table", "register_views", "replay", "stream", "stream_committed", "write", "write_bucketed", "write_committed",
]
