"""Operators for training-data pipelines over documents, pages and benchmarks.

Nothing outside this package imports it.  Each operator module holds one
operator with a general interface; ``queries.py`` holds the registered queries.
"""
