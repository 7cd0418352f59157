"""Collaborative-memory recommendation analytics as Spark DataFrame jobs."""
