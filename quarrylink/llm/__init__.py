"""Operators of a large-scale training-data pipeline.

Every operator takes and returns DataFrames. Nothing outside this subpackage imports it.
"""
