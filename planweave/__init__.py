"""Relational plans, sources, statistics and streams on Spark DataFrames."""
