"""Spark-native analytics for language-model post-training data."""
