"""Query of toxicity scores over the whole `documents` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import toxicity
from millrace.llm.common import Scratch, table


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and verdict of every document; learned from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), Scratch(spark, "toxicity"))
    scored = toxicity.scores(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op6_toxicity": op6_toxicity}
