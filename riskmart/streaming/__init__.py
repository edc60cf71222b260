"""Structured Streaming form of the scoring chain."""
