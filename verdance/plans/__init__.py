"""Queries over the given tables."""
