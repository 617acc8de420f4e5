"""Spark-native analytics for gridded (raster) and geometry data."""
