"""Spark-native analytics over sparse count tables."""
