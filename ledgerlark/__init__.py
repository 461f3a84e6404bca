"""Leak-free analytics over payment event histories, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
