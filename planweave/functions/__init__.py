"""Column statistics and text forms of values."""
