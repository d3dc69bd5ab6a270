"""Spark-native analytics for product scans, caches, histories and event streams."""
