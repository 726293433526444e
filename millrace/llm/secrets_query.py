"""Query of secret scans over the whole `documents` table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import secrets
from millrace.llm.common import table


def op5_secret_scan(spark: SparkSession, sf_dir: str, *, vocabulary: str | None = None) -> DataFrame:
    """Every candidate of every document, with its score and verdict."""
    lexicon = secrets.Lexicon.from_vocabulary(vocabulary or public_tokenizers.path("word_bpe_49k.json"))
    return secrets.scan(table(spark, sf_dir, "documents"), lexicon, secrets.train(lexicon))


QUERIES = {"op5_secret_scan": op5_secret_scan}
