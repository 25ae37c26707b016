"""Readiness reporting and document preparation as Spark DataFrame jobs."""
