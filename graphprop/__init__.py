"""Propagated node features on evolving graphs, as Spark DataFrames."""
