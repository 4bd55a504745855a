"""Spark-native tabular analytics: cleaning, profiling, splitting, learning, evaluation, explanation and search."""
