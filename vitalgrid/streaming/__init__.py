"""Structured Streaming jobs over the serving table."""
