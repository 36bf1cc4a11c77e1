"""Spark-native load analytics: DataFrame operators over request traces and five-minute load series."""

__version__ = "0.1.0"
