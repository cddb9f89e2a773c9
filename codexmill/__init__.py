"""Codexmill: corpus analytics as Spark DataFrame jobs."""
