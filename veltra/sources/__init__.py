"""Strict CSV, the typed catalog, and result sinks."""
