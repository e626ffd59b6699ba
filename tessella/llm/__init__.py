"""Operators for large-scale training-data preparation.

Nothing outside this subpackage imports it.  Every operator is a function from
DataFrames to DataFrames; ``queries`` registers one whole-table query for each.
"""
