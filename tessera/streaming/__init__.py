"""Structured Streaming parts of the engine."""
