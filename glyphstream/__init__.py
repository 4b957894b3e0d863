"""Spark-first analytics over streams of noisy, located observations."""

__version__ = "0.1.0"
