"""Structured Streaming counterparts of the log operators."""
