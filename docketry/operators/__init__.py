"""Relational, graph, vector and store operators on DataFrames."""
