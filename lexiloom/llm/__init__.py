"""Operators for large training-data corpora."""
