"""Structured Streaming forms of conversion, limits, job state and metrics."""
