"""Composed pipelines: search and offline evaluation."""
