"""Registered plans: the driver-facing queries and their DuckDB oracles."""
