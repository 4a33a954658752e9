"""Structured Streaming versions of the pipeline jobs."""
