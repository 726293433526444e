"""Query of SimHash near-duplicate detection over the whole `documents` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import simhash_dedup
from millrace.llm.common import table


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint (16 hex digits) and component of every document."""
    near = simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash_near_dedup": op8_simhash_near_dedup}
