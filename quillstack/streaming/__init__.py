"""Structured Streaming versions of the event consumers."""
