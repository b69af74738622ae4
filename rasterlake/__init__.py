"""Raster frame and frame-sequence analytics as Spark DataFrames."""
