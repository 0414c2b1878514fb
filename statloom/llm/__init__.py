"""Operators for text and names; nothing else in the library imports this package."""
