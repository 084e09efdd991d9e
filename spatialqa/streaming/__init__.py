"""Structured Streaming operators and the user scorer hook."""
