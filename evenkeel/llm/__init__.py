"""Operators for large text corpora: quality, privacy, deduplication, decontamination, scoring, formatting."""
