"""Operators on the log relation; each takes and returns DataFrames."""
