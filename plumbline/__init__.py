"""Plumbline: process-audit analytics expressed as Spark DataFrame jobs."""
