"""Column expressions built from Spark SQL built-ins."""
