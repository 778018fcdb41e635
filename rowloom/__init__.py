"""Relational data synthesis and validation on Spark DataFrames."""

__version__ = "0.2.0"
