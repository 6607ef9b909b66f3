"""Operators on paged tables, as compositions of DataFrame operations."""
