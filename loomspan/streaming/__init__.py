"""Streams: the stateless annotators run unchanged on streaming DataFrames."""
