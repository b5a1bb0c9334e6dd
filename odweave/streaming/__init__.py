"""Structured Streaming forms of the time-aware operators."""
