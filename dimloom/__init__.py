"""Dimensional-warehouse load patterns, reports and checks as Spark DataFrame functions."""

__version__ = "0.1.0"
