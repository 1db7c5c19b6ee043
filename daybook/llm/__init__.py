"""Operators for preparing training text: sharding, search, filters, deduplication, mixing, packing, export."""
