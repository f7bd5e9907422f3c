"""Operators for preparing training data: mixing, fingerprints, packing, extraction,
line dedup, exact top-k search, set-similarity joins, URL, toxicity and quality filters.

Nothing else in the package imports this subpackage; its queries and SQL are in ``queries``.
"""
