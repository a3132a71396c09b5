"""Incremental ingest: the batch report readers run as Structured Streaming file sources."""
