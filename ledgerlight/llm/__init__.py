"""Operators for preparing large text corpora: deduplication, scoring, tokens, packing, search."""
