"""Typed tables and SQL over semi-structured text lines, planned by Spark."""

__version__ = "0.1.0"
