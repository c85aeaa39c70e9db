"""Lacuna: evidence-graph analytics on Spark DataFrames."""
