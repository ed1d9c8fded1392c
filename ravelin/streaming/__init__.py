"""Indexing pages as they arrive."""
