"""Spark-native analytics for entity/game performance tables."""
