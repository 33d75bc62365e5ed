"""Column functions: text, vectors, token counters and fixed values."""
