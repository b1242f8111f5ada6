"""Operators for building training data: deduplication, filters, tokens, packing.

Nothing else in the package imports this subpackage; it can be removed whole.
"""
