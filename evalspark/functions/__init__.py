"""Column-builder functions: each returns a native Spark Column expression."""
