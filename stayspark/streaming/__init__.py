"""Structured Streaming wiring for captured listings (the analytics themselves are batch)."""
