"""Append-only telemetry records on Spark: time-indexed blocks in a ring of generations."""

__version__ = "0.1.0"
