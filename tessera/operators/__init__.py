"""Normalization, parsing and search operators as DataFrame transforms."""
