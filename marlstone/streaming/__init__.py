"""Structured Streaming operators, and how to drain a stream."""
