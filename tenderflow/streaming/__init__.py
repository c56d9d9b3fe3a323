"""Structured Streaming operators on task events."""
