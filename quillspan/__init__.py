"""Extraction-quality analytics written as Spark DataFrame jobs."""
