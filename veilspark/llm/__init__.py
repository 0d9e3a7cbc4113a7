"""Operators for large training-data pipelines, each a module of its own.

Nothing outside this package imports it; ``registry`` lists its queries.
"""
