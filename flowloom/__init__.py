"""Spark-native analytics of captured network flows."""
