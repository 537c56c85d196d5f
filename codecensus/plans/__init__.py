"""Query registry (Spark side), oracle SQL (DuckDB side) and analysis modes."""
