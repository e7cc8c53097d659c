"""Column functions: text, vectors and metrics."""
