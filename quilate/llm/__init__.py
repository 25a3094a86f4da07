"""Operators of a training-data pipeline: deduplication, quality, packing, tokens, search.

Each module holds one operator with a general interface; ``queries`` holds the
thin ``opN_*`` queries that reduce the operators' outputs to digest columns.
Nothing else in the library imports this subpackage.
"""
