"""Spark jobs for city models: buildings, terrain, infill, labels, views and device streams."""
