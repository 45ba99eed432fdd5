"""Structured Streaming forms of the running statistics and of mapping."""
