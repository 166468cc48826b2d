"""Gridded population analytics on Spark."""
