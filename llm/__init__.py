"""Operators for large training-data pipelines: deduplication, packing, mixing, filtering, storage forms."""
