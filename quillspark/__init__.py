"""Spark-native analytics for research documents and personal trading records."""
