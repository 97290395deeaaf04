"""Operators for preparing large text corpora for model training.

Nothing outside this package imports it.  Every operator is a function from
DataFrames to a DataFrame; :mod:`quillfire.llm.registry` names the queries.
"""
