"""mergewell: a Spark-native multi-source record-merge and data-preparation engine."""

__version__ = "1.0.0"
