"""Operators of a training-data pipeline: token counts, filters, duplicates, mixing, sharding."""
