"""Operators for preparing training data: search, extraction, scoring, filters, dedup, mixing."""
