"""Geospatial attribute, vector and shape analytics on Spark."""
