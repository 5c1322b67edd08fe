"""Operators for preparing training text: deduplication, scoring, mixing, packing.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface; ``registry`` holds the registered queries
and their SQL.
"""
