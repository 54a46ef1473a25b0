"""Operators that a training-data pipeline needs over documents and vectors.

Nothing outside this subpackage imports it; queries.py holds the registered
queries and their SQL.
"""
