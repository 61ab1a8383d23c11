"""Structured Streaming forms of the journey operators."""
