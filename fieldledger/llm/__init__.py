"""Operators for preparing training text at scale; nothing outside this package and corpus_pipeline.py imports it."""
