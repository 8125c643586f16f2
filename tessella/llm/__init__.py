"""Training-data operators: quality, search, secrets, deduplication, decontamination, packing, toxicity and PII.

Nothing outside this subpackage imports it.
"""
