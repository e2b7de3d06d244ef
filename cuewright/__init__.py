"""Spark-native engine for speech-and-action training data."""
