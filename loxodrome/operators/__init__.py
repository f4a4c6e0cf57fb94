"""Operators of the point-pattern engine."""
