"""Registered queries and their DuckDB twins."""
