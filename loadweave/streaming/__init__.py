"""Structured Streaming versions of the live operators."""
