"""Larkspur: a Spark-native document store, full-text search engine and data pipeline."""
