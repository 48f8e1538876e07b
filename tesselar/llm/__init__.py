"""Operators for building training data: dedup, packing, scoring, encoding, search, privacy, quality.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
