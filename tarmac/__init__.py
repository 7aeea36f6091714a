"""Compliance-evidence analytics as set-based Spark DataFrame jobs."""
