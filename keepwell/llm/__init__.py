"""Operators of a training-data pipeline.

Each module holds one operator with a general interface; ``queries`` derives the
registered ``opN_*`` results from them.  Nothing outside this package imports it.
"""
