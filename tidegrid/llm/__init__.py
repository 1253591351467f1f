"""Operators for training-data corpora: sharding, near duplicates, quality, leaks, archives, mixing, scoring."""
