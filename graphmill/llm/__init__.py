"""Training-data operators (dedup, sharding, tokenisation, classification).

Nothing outside this subpackage imports it; it can be deleted as a whole.
"""
