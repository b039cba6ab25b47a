"""Structured Streaming variants of the parse and enrich jobs."""
