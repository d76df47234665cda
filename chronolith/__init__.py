"""Temporal interval analytics expressed as Spark DataFrame jobs."""
