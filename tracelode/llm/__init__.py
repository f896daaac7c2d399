"""Operators for training-data pipelines: deduplication, packing, language, secrets, counts and mixes."""
