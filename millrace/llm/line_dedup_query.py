"""Query of fuzzy line deduplication over the whole `documents` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import line_dedup
from millrace.llm.common import table


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its text without repeated lines."""
    out = line_dedup.deduplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.length("text").cast("long").alias("n_chars"), "removed_lines")


QUERIES = {"op10_line_dedup": op10_line_dedup}
