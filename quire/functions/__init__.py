"""Column functions: Spark SQL expressions without a shuffle."""
