"""Incremental maintenance as Structured Streaming."""
