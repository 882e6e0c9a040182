"""Spark-native vulnerability-dataset construction and retrieval-evaluation engine."""
