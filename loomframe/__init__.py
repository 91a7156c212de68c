"""Spark-first analytics: relational, event-time and streaming operators as DataFrame plans."""

__version__ = "0.1.0"
