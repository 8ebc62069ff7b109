"""Spark-native document analytics and hybrid retrieval engine."""
