"""Operators for training-data pipelines: deduplication, filtering, tokenization and scoring of documents.

Nothing else in the library imports this subpackage.
"""
