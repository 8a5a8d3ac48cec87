"""Quern: rule, graph and aggregation queries over large fact tables, as Spark DataFrame jobs."""

__version__ = "0.1.0"
