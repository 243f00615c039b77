"""Operators for language-data preparation. Nothing outside this package imports it."""
