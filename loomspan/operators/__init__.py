"""Operators beyond SQL text: vector search, optimizer-shaped variants, ordering helpers."""
