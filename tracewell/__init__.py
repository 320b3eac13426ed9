"""Lineage analytics on Spark: project graphs and column lineage as DataFrames."""
