"""Composed flows (the four segmentation methods and the series line) and the
registry of named queries with their DuckDB oracles."""
