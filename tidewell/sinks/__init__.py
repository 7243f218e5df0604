"""Loads: full refresh, append, keyed upsert, export."""
