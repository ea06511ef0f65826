"""Incremental arrival of candidate records, as Structured Streaming."""
