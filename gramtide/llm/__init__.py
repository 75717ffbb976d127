"""Training-data operators (deduplication, mixing, tokenising, filtering) for corpora of any size.

Nothing outside this subpackage imports it.
"""
