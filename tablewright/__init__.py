"""Cleaning, profiling and auditing of messy tables on Spark."""

__version__ = "0.1.0"
