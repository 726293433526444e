"""Query of soft-membership mixing over the whole `documents` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import mixing
from millrace.llm.common import Scratch, table

#: Domains are the languages of labelled good documents.
TARGETS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of the documents that the labels call good, with their language as domain."""
    return mixing.labelled_texts(docs, labels.where("quality = 1"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memberships, rate and number of copies of every document."""
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "mixing")
    model = mixing.Membership.learn(labelled_domains(docs, table(spark, sf_dir, "labels")), list(TARGETS))
    members = scratch.save(mixing.memberships(docs.select("doc_id", "source", "text"), model).drop("text"), "members")
    fitted = mixing.fit_rates(members, TARGETS, model.domains, scratch)
    out = mixing.with_rates(members, fitted, "posteriors")
    return out.select("doc_id", "source", "n_tokens", *[F.get("posteriors", i).alias(f"p_{d}") for i, d in enumerate(model.domains)], "rate", mixing.copies(F.col("rate"), F.col("doc_id")).alias("copies"))


QUERIES = {"op3_source_mixing": op3_source_mixing}
