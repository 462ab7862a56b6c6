"""Operators for preparing language-model training text.

Every operator takes DataFrames and gives DataFrames; the queries the entry
point registers are in ``queries.py``.  Nothing outside this subpackage
imports it.
"""
