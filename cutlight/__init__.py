"""Spark-native analytics over media catalogues: moments, text, vectors, identities."""

__version__ = "0.1.0"
