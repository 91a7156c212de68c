"""Structured Streaming twins of the event-time operators."""

from loomframe.streaming.events import deduplicated, dropped_late, enriched, interval_pairs, run_available, session_counts, window_sums
from loomframe.streaming.stateful import rocksdb, running_totals, timed_sessions, type_changes

__all__ = [
    "deduplicated", "dropped_late", "enriched", "interval_pairs", "rocksdb", "run_available", "running_totals", "session_counts", "timed_sessions", "type_changes", "window_sums",
]
