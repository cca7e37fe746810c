"""Operators of large-scale training-data pipelines, one module each.

Nothing outside this subpackage imports it.
"""
