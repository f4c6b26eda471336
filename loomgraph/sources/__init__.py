"""Readers, parsers and durable scratch storage."""
