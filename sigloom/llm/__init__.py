"""Training-data operators: deduplication, filtering, tokenizing, sharding and media columns.

Nothing outside this subpackage imports it.
"""
