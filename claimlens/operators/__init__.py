"""Operators: each one takes DataFrames and returns a DataFrame."""
