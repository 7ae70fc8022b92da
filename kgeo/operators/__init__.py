"""Operators over the graph's tables: DataFrames in, DataFrames out."""
