"""Batch analytics over document, code and observation tables, built on Spark DataFrames."""

__version__ = "0.1.0"
