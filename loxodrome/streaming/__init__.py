"""Streaming of the point-pattern engine."""
