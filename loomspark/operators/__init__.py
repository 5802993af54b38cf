"""Operators over DataFrames, grouped by family."""
