"""Training-data operators: language ID, sharding, extraction, dedup, mixing, packing, search.

Nothing outside this subpackage imports it.
"""
