"""Scalar functions, from Columns to Columns."""
