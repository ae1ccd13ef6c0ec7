"""Operators for training-data pipelines (text quality, safety, dedup, packing, search)."""
