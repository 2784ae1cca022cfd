"""Spark-native analytics for dated announcements and panels of time series."""
