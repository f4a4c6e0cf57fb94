"""Functions of the point-pattern engine."""
