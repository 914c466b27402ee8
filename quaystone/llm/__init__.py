"""Operators for preparing training corpora: privacy, deduplication, filtering, search and packing."""
