"""Operators for text corpora of assets: scoring, similarity, removal, mixing, search.

Nothing else in the library imports this subpackage; it may be removed as a whole.
"""
