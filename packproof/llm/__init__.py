"""Operators for preparing training data, and the queries that apply them.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports it.
"""
