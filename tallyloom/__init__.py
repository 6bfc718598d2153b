"""Spark-native analytics for datasets of structured records extracted from text."""

__version__ = "0.1.0"
