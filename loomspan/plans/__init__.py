"""Whole pipelines and reports composed of operators."""
