"""Analyses that chain several operators and store what more than one step reads."""
