"""Operators for building training corpora: filters, near-duplicates, formatting, tokens, shards and records."""
