"""Property analytics over long (substance, property, value) tables, on Spark."""
