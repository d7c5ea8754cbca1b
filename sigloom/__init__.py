"""Spark-native analytics over sampled signals and event series."""
