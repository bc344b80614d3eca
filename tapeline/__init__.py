"""Spark-native time-series and trade analytics."""
