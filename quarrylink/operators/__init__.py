"""Relational operators of record linkage; each takes and returns DataFrames."""
