"""Masking a stream with the rules of a table."""
