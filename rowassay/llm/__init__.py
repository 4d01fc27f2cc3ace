"""Operators for large training-data corpora, each by a method of its own."""
