"""Readers and writers of article, mapping, prediction and result files."""
