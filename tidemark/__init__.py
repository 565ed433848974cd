"""tidemark: a Spark-native library for time-stamped tabular analytics."""

__version__ = "0.1.0"
