"""Replica reconciliation on Spark: keep two copies of a data estate equal, and prove it."""

__version__ = "0.1.0"
