"""Queries over the test tables, with their DuckDB oracles."""
