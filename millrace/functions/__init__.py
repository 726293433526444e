"""Expressions and scalar functions."""
