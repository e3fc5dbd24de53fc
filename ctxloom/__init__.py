"""Spark-native budgeted selection analytics."""
