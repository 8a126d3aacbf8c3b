"""Operators on DataFrames: graphs, traversal, random graphs, statistics, matching, catalogues."""
