"""Streaming forms of the gates and of deduplication."""
