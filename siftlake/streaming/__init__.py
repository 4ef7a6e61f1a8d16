"""Structured Streaming forms of ingest, watching and live statistics."""
