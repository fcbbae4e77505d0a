"""Reorder-prediction analytics as PySpark DataFrame jobs."""
