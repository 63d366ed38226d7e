"""Leak-free tabular-risk features, metrics and scoring on Spark DataFrames."""
