"""Relational operators, from DataFrames to DataFrames."""
