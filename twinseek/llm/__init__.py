"""Operators of a training-data pipeline: deduplication, mixing, scoring, encoding, scanning, search and sharding."""
