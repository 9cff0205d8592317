"""Operators on the sales fact and on facts derived from it."""
