"""Operators for training-data pipelines. Nothing outside this subpackage imports it.

The queries over the test tables are in :mod:`tallyloom.llm.queries`.
"""
