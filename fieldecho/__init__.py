"""Spark-native analytics for multi-recorder acoustic monitoring archives."""
