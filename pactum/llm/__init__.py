"""Operators for preparing training text: deduplication, filtering, mixing, tokenising, archives."""
