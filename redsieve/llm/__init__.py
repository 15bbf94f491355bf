"""Operators for preparing training corpora, one module each.

Nothing outside this folder imports it; queries.py and sql.py hold what
``__spark_entry__`` registers.
"""
