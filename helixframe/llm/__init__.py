"""Operators that prepare training text: formatting, filtering, de-duplication, sharding and tokenisation.

Nothing outside this subpackage imports it.  Operators take and return DataFrames; the thin queries over the
standard tables are in ``queries.py``.
"""
