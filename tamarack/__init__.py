"""tamarack: a Spark-native analytics engine (SQL dialect, vectors, lake tables)."""

__version__ = "0.1.0"
