"""Operators for training-data corpora: deduplication, quality, language, encoding, sharding, extraction.

Nothing outside this package imports it.
"""
