"""Operators of a training-data pipeline over the tables ``documents``, ``labels`` and ``embeddings``.

Nothing outside this folder imports it.
"""
