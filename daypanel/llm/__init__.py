"""Operators of a training-data pipeline, on ``documents``, ``pages``, ``labels`` and ``benchmark``.

Nothing outside this folder imports it.
"""
