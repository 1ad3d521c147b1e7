"""Dependency-graph analytics on PySpark DataFrames."""
