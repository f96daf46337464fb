"""Operators of a training-data pipeline, their queries and SQL oracles.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it;
``__spark_entry__.py`` adds its queries when it can be imported.
"""
