"""Spark-native analytics for concept-level interpretation of models."""

__version__ = "0.1.0"
