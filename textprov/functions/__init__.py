"""Column-to-Column functions on built-in Spark expressions."""
