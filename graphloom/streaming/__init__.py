"""Structured Streaming over growing graphs."""
