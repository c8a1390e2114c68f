"""Operators for training-data pipelines: tokens, duplicates, contamination, toxicity, licences, languages."""
