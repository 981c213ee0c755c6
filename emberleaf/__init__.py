"""Spark-native document-memory analytics."""
