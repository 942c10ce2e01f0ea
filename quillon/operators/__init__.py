"""operators of the matrix engine."""
