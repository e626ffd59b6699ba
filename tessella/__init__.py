"""Tessella: multi-scale spatial analytics on Spark DataFrames."""
