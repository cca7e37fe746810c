"""Operators over the score corpus; each takes and returns DataFrames."""
