"""Plans of the point-pattern engine."""
