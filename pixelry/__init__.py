"""Raster analytics on Spark: pictures as rows, pixels as a relation."""
