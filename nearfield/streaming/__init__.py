"""Structured Streaming: a fitted model applied to a stream."""
