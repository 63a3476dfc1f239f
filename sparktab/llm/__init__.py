"""Operators for large training-data pipelines (one module each).  Nothing
outside this package imports it, except ``corpus_pipeline.py``, which counts
as part of it, and the guarded import in ``__spark_entry__.py``."""
