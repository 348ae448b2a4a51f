"""Spark-first functions of the engine."""
