"""Streams: scoring of rows that arrive, by the same expressions as tables."""
