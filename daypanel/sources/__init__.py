"""Readers for delimited text, snapshot folders, table ranges, HTML tables and nested JSON; writers."""
