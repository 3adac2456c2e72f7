"""Operators of a training-data pipeline over a ``documents`` table.

Each module holds one operator with a general interface; ``queries`` holds the
thin driver queries.  Nothing outside this package imports it.
"""
