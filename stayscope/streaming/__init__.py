"""Structured Streaming entry points for validation and scoring."""
