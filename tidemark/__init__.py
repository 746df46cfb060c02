"""tidemark: a Spark-native engine for point-in-time market data."""

__version__ = "0.1.0"
