"""Operators for large training-data pipelines.

Nothing else in the package imports this subpackage; the queries that apply
its operators to the tables of a directory are in ``quillon.llm.queries``.
"""
