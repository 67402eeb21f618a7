"""Spark-native analytics for competition records, community activity and text corpora."""
