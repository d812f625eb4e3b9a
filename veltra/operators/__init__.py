"""Scan, join, filter, aggregate, project, sort and limit on DataFrames."""
