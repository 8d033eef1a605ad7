"""telemill: DataFrame operators for publish/subscribe device traffic on Spark."""

__version__ = "0.1.0"
