"""Spark-native retrieval, graph analytics and text processing at batch scale."""
