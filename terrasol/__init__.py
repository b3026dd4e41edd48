"""Terrain raster jobs on Spark."""
