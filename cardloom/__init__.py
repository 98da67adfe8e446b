"""Spark-native engine for curating and checking contrastive training data."""
