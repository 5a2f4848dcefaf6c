"""Structured Streaming jobs built from the same operators."""
