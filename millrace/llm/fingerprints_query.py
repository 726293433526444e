"""Query of document fingerprints over the whole `documents` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import fingerprints
from millrace.llm.common import Scratch, table


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, and their likeness."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = fingerprints.fingerprints_with_neighbours(docs, Scratch(spark, "fingerprints"))
    a, b, following = ([F.col(f"{k}0"), F.col(f"{k}1")] for k in ("a", "b", "next"))
    like = fingerprints.likeness
    return found.select("doc_id", "n_chars", "edited_sha256", fingerprints.text_of(a).alias("fingerprint"), fingerprints.text_of(b).alias("edited_fingerprint"), like(a, b).alias("near_edited"), like(a, following).alias("near_next"), "n_near", "n_near_copies")


QUERIES = {"op4_fingerprints": op4_fingerprints}
