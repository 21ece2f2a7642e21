"""Relational, vector, graph and text operators: DataFrames in, DataFrames out."""
