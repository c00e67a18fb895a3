"""Operators over factor tables."""
