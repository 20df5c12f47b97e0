"""Operators over event streams, for batch and Structured Streaming."""
