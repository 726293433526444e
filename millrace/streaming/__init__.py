"""Pipelines as streaming queries."""
