"""Spark-native analytics for code-change impact data."""
