"""Spark-first analytics for atomistic-structure datasets stored as extended-XYZ text."""
