"""Relational, graph, text and state operators over DataFrames."""
