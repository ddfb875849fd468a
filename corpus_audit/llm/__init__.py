"""Operators of a training-data pipeline: sharding, quality, near duplicates, decontamination, language, mixing, tokens."""
