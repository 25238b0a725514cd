"""Spark-native analytics over large sets of 3-D points."""

__version__ = "0.1.0"
