"""Column functions: plain expressions over built-in functions, no Python per row."""
