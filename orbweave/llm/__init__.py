"""Operators for large training-text pipelines.

Nothing outside this subpackage imports it.  Each module holds one operator with
its own general interface and the thin ``opN_`` query that applies it.
"""
