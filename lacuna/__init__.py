"""Lacuna: analytics over relational data with missing tuples, on Spark."""

__version__ = "0.1.0"
