"""Query of the BPE codec over the whole `documents` table."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.llm import bpe
from millrace.llm.common import table

VOCABULARY = "word_bpe_49k.json"


def _sha256(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8")).hexdigest()


def op1_bpe_codec(spark: SparkSession, sf_dir: str, *, vocabulary: str | None = None) -> DataFrame:
    """Digests of the token ids and of the decoded text of every document.

    `vocabulary` is the path of a tokenizer file on the driver.
    """
    made = T.StructType().add("n_tokens", T.LongType()).add("ids_sha256", T.StringType()).add("decoded_sha256", T.StringType())
    spec = bpe.read_spec(vocabulary or public_tokenizers.path(VOCABULARY))
    return bpe.map_encoded(table(spark, sf_dir, "documents"), spec, lambda e: (len(e), _sha256(e.ids_text), _sha256(e.decoded)), made, keep=["doc_id"])


QUERIES = {"op1_bpe_codec": op1_bpe_codec}
