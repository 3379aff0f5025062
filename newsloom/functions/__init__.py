"""Column functions and the few vectorised Python functions."""
