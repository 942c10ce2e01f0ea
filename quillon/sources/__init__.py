"""sources of the matrix engine."""
