"""Touchline: Spark-native analytics for tracked-object sport data and text corpora."""
