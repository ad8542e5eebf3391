"""Training-data operators: quality rules, language id, deduplication, secret
scans, decontamination, toxicity, sharding, token output and mixing.

Nothing outside this subpackage imports it.
"""
