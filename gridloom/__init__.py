"""Analyses over large public energy and market tables, written as Spark DataFrame jobs."""
