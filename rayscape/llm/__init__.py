"""Operators for building language-model training corpora on Spark.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
