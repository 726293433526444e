"""Scalar text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(text: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 one hyphen, none at the ends."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.regexp_replace(lower, "[^a-z0-9]+", "-"), "^-|-$", "")


def normalize_labels(labels: Column) -> Column:
    """Labels trimmed, in lower case, without empty ones, sorted, each once."""
    trimmed = F.transform(labels, lambda x: F.translate(F.trim(x), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda x: x != "")))


def floor_to(value: Column, step: int) -> Column:
    """The largest multiple of `step` that is not above a nonnegative whole number."""
    return value - F.pmod(value, F.lit(step))


def strip_prefix(text: Column, *prefixes: str) -> Column:
    """The text without the first of the prefixes that it begins with; as it is if there is none."""
    out = text
    for p in reversed(prefixes):
        out = F.when(text.startswith(p), F.substr(text, F.lit(len(p) + 1))).otherwise(out)
    return out
