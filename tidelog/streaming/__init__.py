"""Ingest as a stream of request files."""
