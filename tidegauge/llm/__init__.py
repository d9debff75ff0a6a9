"""Operators for preparing training text: scoring, deduplication, tokenizing, packing and search."""
