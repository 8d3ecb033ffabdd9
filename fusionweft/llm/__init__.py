"""Operators for preparing a training corpus: filtering, deduplication, search, mixing, packing and storage.

Nothing else in the library imports this subpackage. It can be deleted as a whole.
"""
