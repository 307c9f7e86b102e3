"""Spark-native vector and document analytics."""
