"""Operators of a training-data pipeline: search, mixing, joins, tokenising, filters, fingerprints, dedup and scoring."""
