"""Structured Streaming versions of the page pipeline."""
