"""Structured Streaming jobs over change and message feeds."""
