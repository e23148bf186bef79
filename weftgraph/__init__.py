"""A code-knowledge-graph engine on Spark DataFrames."""
