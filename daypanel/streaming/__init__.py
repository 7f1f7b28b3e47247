"""Incremental ingest of snapshot folders."""
