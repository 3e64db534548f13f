"""Operators for preparing text corpora: cleaning, de-duplication, search, encoding."""
