"""Watermarks, incremental syncs, streaming upserts and rollups."""
