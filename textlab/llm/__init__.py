"""Operators for preparing training text and embeddings at corpus scale.

Nothing outside this package imports it (except the guarded registration in
``__spark_entry__.py`` and ``corpus_pipeline.py``), so it can be removed whole.
"""
