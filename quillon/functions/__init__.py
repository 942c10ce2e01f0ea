"""functions of the matrix engine."""
