"""Raster and region analytics as Spark DataFrame operators."""
