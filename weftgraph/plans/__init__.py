"""Logical plans: the graph view of relational tables and the pattern language."""
