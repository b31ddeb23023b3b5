"""Similarity search and metric analytics as PySpark DataFrame programs."""
