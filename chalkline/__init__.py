"""Corpus-wide analytics over recorded courses and the documents written from them, on Spark."""
