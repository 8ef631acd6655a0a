"""Operators of a training-data pipeline: deduplication, filtering, formatting and mixing of text."""
