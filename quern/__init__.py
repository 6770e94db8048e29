"""Spark-native knowledge retrieval analytics and corpus preparation."""
