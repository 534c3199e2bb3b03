"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; ``queries`` binds the operators to
the standard tables.
"""
