"""Spark-first analytics for planetary lidar, rasters and image features."""
