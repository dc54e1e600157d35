"""Operators for preparing training text: filtering, deduplication, scoring and mixing of documents.

Nothing else in the library imports this subpackage. Every operator selects the columns it needs
first, so further columns of its input, whatever their names, cannot clash with its own.
"""
