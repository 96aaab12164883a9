"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  Operators live in one
module each, their registered queries and SQL in :mod:`spanwell.llm.queries`.
"""
