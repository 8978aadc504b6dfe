"""Operators for text and code corpora used as language-model training data."""
