"""Operators for training-data pipelines on Spark: packing, near-duplicate joins, extraction, scoring, filters.

Each module is one operator.  ``hourglass.llm.queries`` registers them over the driver tables.  Nothing outside this
subpackage imports it, apart from the guarded hook in ``__spark_entry__`` and ``corpus_pipeline.py``.
"""
