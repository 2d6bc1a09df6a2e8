"""Relational operators: DataFrames in, DataFrames out, `as_of` always a parameter."""
