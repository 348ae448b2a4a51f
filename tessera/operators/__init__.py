"""Spark-first operators of the engine."""
