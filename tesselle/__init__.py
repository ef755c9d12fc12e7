"""Raster algebra on Spark DataFrames."""
