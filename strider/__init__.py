"""Spark-native analytics for motion time series and paired benchmark statistics."""
