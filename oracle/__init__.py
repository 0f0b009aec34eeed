"""DuckDB statements that state each query independently, for comparison with Spark."""
