"""Operators of a training-data pipeline: one module per operator, plus queries.py.

Nothing outside this folder (except corpus_pipeline.py and the guarded import
in __spark_entry__.py) depends on it.
"""
