"""Spark-native districting analytics."""
