"""Spark-native analytics over graded trials, judgments, labels and append-only run logs."""

__version__ = "0.1.0"
