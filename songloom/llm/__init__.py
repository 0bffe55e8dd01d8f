"""Operators of a training-data pipeline: sampling, deduplication, scoring, counting, packing, extraction."""
