"""Query of license scans over the whole `documents` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import licenses
from millrace.llm.common import table


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every region of a document that a license template covers."""
    return licenses.scan(table(spark, sf_dir, "documents"))


QUERIES = {"op9_license_scan": op9_license_scan}
