"""Column functions. All are native Spark expressions."""
