"""Operators for large training-data pipelines, on Spark.

Nothing outside this subpackage imports it; `__spark_entry__.py` adds its
queries only where it can be imported.
"""
