"""Column functions: no joins, no aggregates."""
