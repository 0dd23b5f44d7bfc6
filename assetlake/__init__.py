"""Spark-native analytics for large collections of image assets."""
