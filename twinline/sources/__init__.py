"""Readers and writers for pairs, lines and vocabularies."""
