"""Operators for preparing training data: deduplication, scoring, mixing, packing, search and output.

Nothing else in the library imports this subpackage.
"""
