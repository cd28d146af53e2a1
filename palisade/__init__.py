"""A Spark-native analytics engine for HTTP attack events."""
