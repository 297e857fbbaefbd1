"""Spatial network analytics on Spark: points, chunks, joins and morphologies as DataFrames."""
