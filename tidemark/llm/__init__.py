"""Corpus operators for training data: each registers one query, with DuckDB text where SQL can express it."""
