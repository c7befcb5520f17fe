"""Spark-native preparation, indexing and retrieval of legal and contract corpora."""
