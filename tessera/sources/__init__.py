"""Spark-first sources of the engine."""
