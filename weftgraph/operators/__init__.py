"""Graph, text, vector and maintenance operators on DataFrames."""
