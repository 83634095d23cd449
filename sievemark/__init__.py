"""Spark-native text compliance analytics."""
