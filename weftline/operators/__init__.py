"""Answers over nodes and edges as DataFrames."""
