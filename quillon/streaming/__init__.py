"""streaming of the matrix engine."""
