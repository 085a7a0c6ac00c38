"""Spark-first analytics for multi-channel time-series recordings."""

__version__ = "0.1.0"
