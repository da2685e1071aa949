"""Spark-native analytics for media-transport event logs."""
