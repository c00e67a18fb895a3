"""Scans and sinks with strict contracts."""
