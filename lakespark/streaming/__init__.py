"""Structured Streaming in and out of tables."""
