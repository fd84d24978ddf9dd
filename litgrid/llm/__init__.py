"""Corpus operators for training data: deduplication, scoring, tokenizing, search and sharding."""
