"""weir: a Spark-native engine for checking, cleaning and monitoring tables."""

__version__ = "0.1.0"
