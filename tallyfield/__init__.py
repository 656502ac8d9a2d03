"""Spark-native analytics for match, price, trade and event records."""
