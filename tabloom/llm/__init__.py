"""Operators of a training-data pipeline: tokens, scoring, near and exact duplicates, packing, languages, secrets."""
