"""Operators of a training-data pipeline (mixing, filters, dedup, formatting)."""
