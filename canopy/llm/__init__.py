"""Operators for large text and vector corpora used to prepare training data."""
