"""Queries over the test tables, each with its DuckDB oracle where SQL can express it."""
