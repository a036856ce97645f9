"""Resumable scoring with append-only Structured Streaming."""
