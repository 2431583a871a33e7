"""Column-in, column-out helpers built from Spark's own functions."""
