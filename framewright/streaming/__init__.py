"""Structured Streaming forms of what the batch operators do to whole tables."""
