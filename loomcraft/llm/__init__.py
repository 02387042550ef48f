"""Operators of a training-data pipeline: deduplication, packing, encoding, archives, counts, scores.

``catalog`` registers one query per operator. Nothing outside this package imports it but
``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
