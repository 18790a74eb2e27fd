"""Operators for preparing training data: language ID, deduplication, search, packing, mixing and filters."""
