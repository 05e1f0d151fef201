"""Spark-native analytics for panel time series (many entities, ordered dates)."""
