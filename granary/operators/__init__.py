"""Relational operators of the retrieval pipeline."""
