"""Registered queries, their inputs derived from the given tables, and their DuckDB oracles."""
