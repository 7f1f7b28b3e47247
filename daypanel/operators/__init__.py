"""Operators on DataFrames: reshape, joins, filters, selection, windows, statistics, projection."""
