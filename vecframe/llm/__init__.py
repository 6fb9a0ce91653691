"""Operators for building language-model training data.

Nothing else in the library imports this subpackage; it can be removed
without touching the vector engine.  Queries are in ``vecframe.llm.queries``.
"""
