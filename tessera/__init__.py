"""Spark-native analytics for volumes, point tables, label hierarchies and spatial graphs."""

__version__ = "0.1.0"
