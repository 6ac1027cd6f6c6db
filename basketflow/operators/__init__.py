"""Operators over the canonical event model; each takes and returns DataFrames."""
