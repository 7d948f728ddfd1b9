"""Spark-first analytics for media-monitoring tables."""

__version__ = "0.1.0"
