"""Training-data operators (deduplication, filtering, fingerprints, search, mixing, tokens).

Nothing outside this subpackage imports it.
"""
