"""Append-only knowledge records on Spark: recall, lineage, reconciliation and corpus preparation."""

__version__ = "0.1.0"
