"""Spark-native similarity, drift and code-health analytics."""

__version__ = "0.1.0"
