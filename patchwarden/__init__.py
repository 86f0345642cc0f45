"""Spark-native vector anomaly analytics."""
