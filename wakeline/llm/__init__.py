"""Operators for training-data pipelines: filtering, near-duplicates, search, mixing, archives, tokens."""
