"""Derived tables and named queries."""
