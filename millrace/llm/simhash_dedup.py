"""Near-duplicate documents by SimHash and meet-in-the-middle ball hashing.

Two fingerprints at most `radius` bits apart have a common neighbour at most half
as far from either. Every distinct fingerprint therefore emits all variants within
half the radius; one shuffle on the variant brings linked fingerprints together.
All members of a variant's group lie within the radius of each other, so a chain
through the sorted group is a set of true links with the same components, and no
group emits all its pairs (a group has at most 1 + 64 members for radius 2).
Copies are collapsed to one fingerprint before anything is emitted, so a group of
copies costs as much as one document, whatever its size.

Defined results: a null or empty text has fingerprint zero and is linked like any
other; fewer words than a shingle give one shingle of all words; rows of one
doc_id are fingerprinted each; a null doc_id never names a component unless all
documents of the component have none; extra columns are not looked at; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, fresh_name
from millrace.llm.components import connected_components

SHINGLE = 3
RADIUS = 2
SEED = 42
BITS = 64
_BLOCK = 1 << 16


def text_fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a whole text: a bit is set if more than half of the shingles' hashes have it."""
    words = (text or "").encode("utf-8").lower().split()  # on bytes, both know ASCII only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    votes = np.zeros(BITS, dtype=np.int64)
    for lo in range(0, n, _BLOCK):
        part = words[lo : lo + _BLOCK + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if n > 1 or len(words) == shingle else [b" ".join(words)]
        h = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), dtype="<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, fp): the fingerprint of each row's text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((text_fingerprint(t.as_py(), shingle) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return df.select(df[f"`{doc_id}`"].cast("long"), df[f"`{text}`"].cast("string")).mapInArrow(run, "doc_id long, fp long")


def _ball(fp: Column, radius: int) -> Column:
    """All values at most `radius` bits from `fp`."""
    masks = [0]
    grown = [(0, -1)]
    for _ in range(radius):
        grown = [(m | 1 << k, k) for m, last in grown for k in range(last + 1, BITS)]
        masks += [m for m, _ in grown]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    return F.explode(F.array(*[fp.bitwiseXOR(F.lit(m).cast("long")) for m in signed]))


def links(distinct: DataFrame, fp: str = "fp", radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within an even radius, for distinct fingerprints."""
    if radius % 2 or radius < 0:
        raise ValueError("the radius must be even")
    variants = distinct.select(F.col(fp).alias("b"), _ball(F.col(fp), radius // 2).alias("variant"))
    before = F.lag("b").over(Window.partitionBy("variant").orderBy("b"))
    met = variants.select("b", before.alias("a")).where(F.col("a").isNotNull())
    return met.select("a", "b").distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Rows (doc_id, fp, component_id), one for each row of `df`.

    Documents whose fingerprints differ in at most `radius` bits are linked;
    component_id is the smallest doc_id that links lead to.
    """
    scratch = Scratch(df.sparkSession, "simhash")
    docs = scratch.save(fingerprints(df, doc_id=doc_id, text=text, shingle=shingle), "fingerprints")
    distinct = scratch.save(docs.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    found = connected_components(links(distinct.select("fp"), "fp", radius), "a", "b", scratch)
    found = scratch.save(found, "components")
    # Most fingerprints are alone: only those in components need a second look.
    inside = distinct.join(found, F.col("fp") == F.col("node")).select("fp", "root", "first_id")
    least = inside.groupBy("root").agg(F.min("first_id").alias("component_id"))
    grouped = inside.join(least, "root").select("fp", "component_id")
    # Saved, so that in the join with the documents Spark can split the rows of a fingerprint that a third of them have.
    named = scratch.save(distinct.join(grouped, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id")), "named")
    scratch.drop(distinct, found)
    return docs.join(named.hint("shuffle_hash"), "fp").select("doc_id", "fp", "component_id")


def keep_one(df: DataFrame, near: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """The rows of `df` without all but one document of each component of `near`.

    The document with the smallest doc_id stays. Of rows that share its doc_id the one
    with the smallest hash of its columns stays (equal hashes: equal rows, but for a
    chance of 2^-64). Rows without a doc_id can't be told apart and stay.
    """
    kept = near.where("doc_id = component_id").select(F.col("doc_id").alias(doc_id)).distinct()
    row = fresh_name(df, "row")
    one = F.row_number().over(Window.partitionBy(doc_id).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])))
    named = df.join(kept, doc_id, "left_semi").select(*[F.col(f"`{c}`") for c in df.columns], one.alias(row))
    return named.where(F.col(row) == 1).drop(row).unionByName(df.where(F.col(doc_id).isNull()))
