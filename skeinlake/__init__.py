"""Spark-native indexing and retrieval analytics over text corpora."""
