"""Statements as text."""
