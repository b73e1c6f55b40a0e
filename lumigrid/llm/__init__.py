"""Operators that prepare text, pages and embeddings for model training.

Nothing else in the library imports this subpackage.
"""
