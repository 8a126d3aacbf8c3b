"""Column functions and ordered aggregates."""
