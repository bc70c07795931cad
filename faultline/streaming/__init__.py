"""Structured Streaming: ingest, dedupe, sessions and index upkeep."""
