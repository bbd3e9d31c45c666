"""Operators for training data; nothing outside this folder but corpus_pipeline.py imports it."""
