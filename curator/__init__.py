"""Curator: a PySpark-native engine for content curation."""
