"""Loomspan: text annotation, knowledge-graph mappings and evaluation analytics on Spark DataFrames."""
