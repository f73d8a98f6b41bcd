"""Operators: each builds a DataFrame plan from DataFrames."""
