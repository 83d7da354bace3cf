"""Logical plans: nodes, builder, JSON form, analysis and compilation to DataFrames."""
