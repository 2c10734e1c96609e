"""Spark analytics for very large wildlife-photo collections."""
