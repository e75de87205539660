"""Spark-native analytics for paired token-sequence corpora."""
