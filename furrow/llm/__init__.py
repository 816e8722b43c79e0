"""Operators for preparing text corpora, and the queries that apply them."""
