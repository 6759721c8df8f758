"""Spark jobs for road graphs, travel-time fields and training-data preparation."""
