"""Operators for training-data pipelines (tokenising, dedup, quality, mixing)."""
