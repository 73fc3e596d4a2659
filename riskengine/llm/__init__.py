"""Training-data pipeline operators: one module per operator, on Spark DataFrames.

The operators take and return DataFrames; ``queries.py`` registers one query per
operator and holds the SQL oracles. Nothing outside this subpackage imports it
except ``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
