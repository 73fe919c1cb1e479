"""Independent ANSI SQL for every query key, run by DuckDB on the same tables."""
