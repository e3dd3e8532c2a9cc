"""tessella: a Spark-native engine for preparing, indexing, searching and evaluating document collections."""

__version__ = "0.1.0"
