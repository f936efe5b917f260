"""Incremental processing: change feeds, refresh of derived tables, windows, alerts."""
