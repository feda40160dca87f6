"""Spark-native analytics over source-code corpora, audit findings and the data around them."""

__version__ = "0.1.0"
