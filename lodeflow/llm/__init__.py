"""Operators for text corpora and huge identifier sets. Nothing outside this package imports it."""
