"""Spark-native time-series analytics for keyed sensor readings."""

__version__ = "0.1.0"
