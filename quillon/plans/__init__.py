"""plans of the matrix engine."""
