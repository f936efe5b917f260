"""Relational building blocks: range-split windows, joins, aggregates, top-k, set operations."""
