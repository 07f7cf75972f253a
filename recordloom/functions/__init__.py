"""Column-to-column helpers: built-in Spark expressions only, no Python per row."""
