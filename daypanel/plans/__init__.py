"""Whole pipelines: from landed inputs to panels and from panels to report tables."""
