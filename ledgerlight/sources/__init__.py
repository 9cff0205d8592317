"""Readers, conforming and sinks."""
