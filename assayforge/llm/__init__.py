"""Operators for large training corpora.

Nothing else in the library imports this subpackage; ``assayforge.llm.bindings``
lists its queries and their SQL.
"""
