"""Operators on tracking, event and annotation tables; each takes and returns DataFrames."""
