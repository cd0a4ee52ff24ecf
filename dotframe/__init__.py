"""dotframe: a Spark-native analytics engine for tactile-dot page data."""

__version__ = "0.1.0"
