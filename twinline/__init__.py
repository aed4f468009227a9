"""Spark toolkit for parallel (two-language) text corpora.

Every operator takes a DataFrame (or a path) and gives a DataFrame back; the
plan stays declarative so that Catalyst and AQE choose the physical strategy.
"""
