"""Operators for large-scale training-data pipelines.

Nothing outside this package imports it.  ``ashlar.llm.registry`` lists the
queries and their SQL; ``corpus_pipeline.py`` chains five operators.
"""
