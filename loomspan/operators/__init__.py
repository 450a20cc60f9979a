"""Operators over articles, mentions, mappings and type graphs: DataFrames in, a DataFrame out."""
