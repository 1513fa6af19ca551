"""DuckDB statements that answer each registered query independently."""
