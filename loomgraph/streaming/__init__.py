"""Structured Streaming forms of the state operators."""
