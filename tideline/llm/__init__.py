"""Operators for preparing training text: deduplication, filtering, scoring, archives and packing."""
