"""Operators for training-data pipelines: filtering, deduplication, search, mixing and packing."""
