"""Query of the learned quality rules over the whole `documents` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import quality
from millrace.llm.common import table


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality.learn_decision_list(docs, table(spark, sf_dir, "labels"))
    return quality.judge(docs, rules).select("doc_id", *quality.BASE, "base_failed", "kept")


QUERIES = {"op7_quality_rules": op7_quality_rules}
