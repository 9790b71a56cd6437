"""Operators for large training corpora: filtering, deduplication, tokenising, scoring, search and archives."""
