"""Column expressions and text functions."""
