"""Sources of the point-pattern engine."""
