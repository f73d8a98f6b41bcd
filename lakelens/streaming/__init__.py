"""Structured Streaming: incremental profiles of arriving files."""
