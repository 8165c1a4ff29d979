"""Structured Streaming variants of scoring."""
