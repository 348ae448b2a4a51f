"""Spark-first plans of the engine."""
