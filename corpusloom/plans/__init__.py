"""Queries, their SQL, and pipelines of steps."""
