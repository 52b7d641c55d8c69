"""Structured Streaming on event tables. An extension: the SQL surface itself is batch only."""
