"""Operators on clouds: each takes DataFrames and gives a DataFrame."""
