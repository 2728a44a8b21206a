"""Selective-prediction and model-routing analytics as plain Spark DataFrame jobs."""

__version__ = "0.1.0"
