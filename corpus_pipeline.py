"""A corpus pipeline of training-data operators: raw documents to token ids.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and
returns a DataFrame that is written as Parquet and read again for the next stage.
All but the last return the columns of `documents`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import bpe, line_dedup, mixing, quality, simhash_dedup
from millrace.llm.common import WORD_PATTERN, Scratch, fresh_name, table
from millrace.llm.mixing_query import TARGETS, labelled_domains


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned decision list reject go.

    A null or empty text has no words and goes, by the base rules. A null doc_id has no
    label to learn from and is judged like any other. Repeated rows are judged alike and
    all stay or go. Without labels only the base rules judge. An empty table stays empty.
    """
    rules = quality.learn_decision_list(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, rules)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so do documents of which that leaves no word.

    Of equal or similar lines the first by (doc_id, line number) stays, a null doc_id
    coming first. Texts that are null, empty or blank have no lines to lose and stay as
    they are. Repeated rows (equal doc_id and text) are one document and keep the same
    lines. n_chars is counted anew where lines went. An empty table stays empty.
    """
    out = line_dedup.deduplicate_lines(docs)
    empty = (F.col("removed_lines") > 0) & ~F.coalesce(F.col("text"), F.lit("")).rlike(WORD_PATTERN)
    out = out.where(~empty)
    return out.select(*[F.when(F.col("removed_lines") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id.

    Texts without words have fingerprint zero and are one group. Of rows that share the
    doc_id that stays, the one with the smallest hash of all its columns does. Rows
    without a doc_id stay. An empty table stays empty.
    """
    return simhash_dedup.keep_one(docs, simhash_dedup.near_duplicates(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated by their rates, so that the domains' tokens match TARGETS.

    Texts that are null or empty have no tokens; they stay once, as their rate moves no
    total. Rows that are repeated have equal rates and are settled alike. Without labelled
    documents all domains are equally likely. An empty table stays empty.
    """
    labels = table(spark, sf_dir, "labels")
    scratch = Scratch(spark, "mixing")
    model = mixing.Membership.learn(labelled_domains(docs, labels), list(TARGETS))
    row = F.xxhash64("doc_id", "text")  # rows that it can't tell apart have one text and so one rate
    members = scratch.save(mixing.memberships(docs.select("doc_id", row.alias("row_key"), "text"), model).drop("text"), "members")
    fitted = mixing.fit_rates(members, TARGETS, model.domains, scratch)
    rates = mixing.with_rates(members, fitted, "posteriors").select("row_key", "doc_id", F.when(F.col("n_tokens") > 0, mixing.copies(F.col("rate"), F.col("doc_id"))).otherwise(1).alias("times"))
    key, times = fresh_name(docs, "row_key"), fresh_name(docs, "times")
    many = rates.where("times != 1").groupBy(F.col("row_key").alias(key)).agg(F.max("times").alias(times))
    timed = docs.withColumn(key, row).join(many, key, "left")
    return timed.withColumn(times, F.explode(F.sequence(F.lit(1), F.coalesce(times, F.lit(1))))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digest of the text that decoding them gives.

    A null or empty text has no tokens, and an empty text is what they decode to. Every
    row is encoded, repeated ones and those without a doc_id too. An empty table stays
    empty.
    """
    spec = bpe.read_spec(public_tokenizers.path("word_bpe_49k.json"))
    made = T.StructType().add("token_ids", T.ArrayType(T.IntegerType(), False)).add("n_tokens", T.LongType()).add("decoded_sha256", T.StringType())
    return bpe.map_encoded(docs, spec, lambda e: (e.ids, len(e), hashlib.sha256(e.decoded.encode("utf-8")).hexdigest()), made, keep=["doc_id", "lang", "source"])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_documents),
    ("mixing sources", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: Learned rules, fingerprints and token ids can't be had in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": run}
SQL: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
