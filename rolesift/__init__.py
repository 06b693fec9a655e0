"""Posting-discovery analytics as Spark DataFrame jobs."""
