"""Operators of a training-data pipeline: dedup, packing, scoring, extraction.

Nothing outside this subpackage (and corpus_pipeline.py) imports it.
"""
