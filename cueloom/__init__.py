"""Timed-text analytics as PySpark DataFrame operators."""
