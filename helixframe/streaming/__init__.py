"""Structured Streaming over the same expressions."""
