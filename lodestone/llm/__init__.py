"""Operators that prepare training text: deduplication, scoring, tokens, sharding, packing and search."""
