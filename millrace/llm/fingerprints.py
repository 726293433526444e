"""SimHash document fingerprints, and search for all within a Hamming radius.

A fingerprint has 128 bits. The terms are pairs of neighbouring words (a text of
one word has that word), lower case; each occurrence hashes to 128 signed votes,
so that a term's weight is its number of occurrences, and a bit is set where the
votes are positive. All of it is DataFrame expressions: votes are counted two to a
long by ordinary sums, right where a text's terms are made, without a shuffle.

`within_radius` uses permuted block tables: the bits are cut into blocks, so many
that two fingerprints within the radius differ in at most `flips` bits of one of
them; each table is keyed by one block and asked for the block's value with every
choice of that many bits flipped, and a hit in several is verified and told once.
Equal fingerprints are one entry, so groups of copies don't multiply.

Two radii are counted: `RADIUS`, within which there is little but exact copies, and
`COPY_RADIUS`, which takes in copies with a few words changed.

`next_in_order` gives each row the text of the next one without a global sort: the
order is cut into ranges by quantiles, rows are shuffled by range once, and the
first row of each range is also sent to the range before.

Defined results: a null or empty text has no terms and fingerprint zero; the order
is by descending doc_id, ties by descending text, null doc_ids last; the last row
is followed by the first, a single row by itself; rows that are repeated stay;
extra columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD_SPLIT, Scratch

BITS = 128
RADIUS = 3
COPY_RADIUS = 20  # near copies (5-word Jaccard 0.8 or more) lie up to 19 bits apart
FLIPS = 2
_HALF = 1 << 32
_FIRST = -(1 << 63)


def terms(text: Column) -> Column:
    """Array of the 64-bit hashes of a text's terms, repeats included."""
    words = F.filter(F.split(F.lower(text), WORD_SPLIT, -1), lambda w: w != "")
    pairs = lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.xxhash64(a, b))
    of = F.transform(F.array(words), lambda w: F.when(F.size(w) > 1, pairs(w)).otherwise(F.transform(w, lambda a: F.xxhash64(a))))
    return F.get(of, F.lit(0))


def _hash_words(term: Column) -> list[Column]:
    return [term, F.when(term.isNotNull(), F.xxhash64(term, F.lit(1)))]


def vote_sums(term: str) -> list[Column]:
    """Aggregates that count set bits: of bits i and i + 32 of a word in the halves of one long."""
    pair = F.lit(_HALF + 1).cast("long")
    return [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(pair)).alias(f"v{k}_{i}") for k, h in enumerate(_hash_words(F.col(term))) for i in range(32)]


def vote_bits(total: Column) -> list[Column]:
    """The two words of a fingerprint from the sums of `vote_sums` and the number of terms."""
    out = []
    for k in range(2):
        bits = F.lit(0).cast("long")
        for i in range(64):
            v = F.coalesce(F.col(f"v{k}_{i % 32}"), F.lit(0).cast("long"))
            count = F.shiftrightunsigned(v, 32) if i >= 32 else v.bitwiseAND(F.lit(_HALF - 1))
            bits = bits.bitwiseOR(F.shiftleft((2 * count > total).cast("long"), i))
        out.append(bits)
    return out


def likeness(a: list[Column], b: list[Column]) -> Column:
    """Share of equal bits."""
    apart = F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))
    return F.lit(1.0) - apart / F.lit(float(BITS))


def text_of(words: list[Column]) -> Column:
    """A fingerprint as 32 hexadecimal digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(w), 16, "0") for w in words]))


def _ranges(df: DataFrame, key: str, n: int) -> list[int]:
    """Upper bounds, all of them values of `key`, that cut it into about `n` even ranges."""
    shares = [i / n for i in range(1, n)]
    r = df.agg(F.max(key).alias("top"), F.percentile_approx(key, shares or [0.5], max(10_000, 20 * n)).alias("cuts")).first()
    return sorted({*(r["cuts"] or []), *([] if r["top"] is None else [r["top"]])} or {0})


def next_in_order(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """Rows (part, pos, extra, doc_id, text, next_text) of `df` by descending doc_id within each `part`.

    Rows with `extra` are the first of the part that follows; they only serve what
    looks one row ahead. `ranges` should grow with the data: by default four for
    each shuffle partition.
    """
    spark = df.sparkSession
    ranges = ranges or max(1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(df[f"`{doc_id}`"].cast("long").alias("doc_id"), F.coalesce(df[f"`{text}`"].cast("string"), F.lit("")).alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(_FIRST)))
    bounds = _ranges(rows.select("key"), "key", ranges)
    width = math.isqrt(len(bounds) - 1) + 1
    chunks = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    coarse = F.from_json(F.lit(json.dumps([c[-1] for c in chunks])), "array<bigint>")
    fine = F.from_json(F.lit(json.dumps(chunks)), "array<array<bigint>>")
    rows = rows.withColumn("c", F.size(F.filter(coarse, lambda b: b < F.col("key"))))
    rows = rows.withColumn("f", F.size(F.filter(F.get(fine, F.col("c")), lambda b: b < F.col("key"))))
    part = F.col("c") * width + F.col("f")
    is_bound = F.get(F.get(fine, F.col("c")), F.col("f")) == F.col("key")
    own = F.struct(part.alias("part"), F.lit(False).alias("extra"))
    ahead = F.struct(F.pmod(part + 1, F.lit(len(bounds))).alias("part"), F.lit(True).alias("extra"))
    dealt = rows.select("doc_id", "text", "key", F.explode(F.when(is_bound, F.array(own, ahead)).otherwise(F.array(own))).alias("at")).select("at.part", "at.extra", "doc_id", "text", "key")
    w = Window.partitionBy("part").orderBy(F.when(~F.col("extra"), F.col("key")).desc_nulls_last(), F.desc("key"), F.desc("text"))
    return dealt.select("part", F.row_number().over(w).alias("pos"), "extra", "doc_id", "text", F.lead("text").over(w).alias("next_text"))


def edited_text(text: Column, following: Column) -> Column:
    """`text` with its last half replaced by as much of the beginning of `following`."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def fingerprint_documents(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """Rows (doc_id, n_chars, edited_sha256, a0, a1, b0, b1, next0, next1), one for each row of `df`.

    (a0, a1) is the fingerprint of the text, (b0, b1) that of the edited text and
    (next0, next1) that of the next document.
    """
    rows = next_in_order(df, doc_id=doc_id, text=text, ranges=ranges)
    rows = rows.withColumn("edited", F.when(~F.col("extra"), edited_text(F.col("text"), F.col("next_text"))))
    versions = F.array(F.struct(F.lit(0).alias("version"), terms(F.col("text")).alias("terms")), F.struct(F.lit(1).alias("version"), terms(F.coalesce("edited", F.lit(""))).alias("terms")))
    keys = ["part", "pos", "extra", "doc_id", "n_chars", "edited_sha256"]
    made = rows.select("part", "pos", "extra", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.explode(versions).alias("v"))
    each = made.select(*keys, "v.version", F.explode_outer("v.terms").alias("term"))
    votes = each.groupBy(*keys, "version").agg(F.count("term").alias("total"), *vote_sums("term"))
    bits = vote_bits(F.col("total"))
    words = votes.select(*keys, "version", bits[0].alias("w0"), bits[1].alias("w1"))
    pick = lambda v, w: F.max(F.when(F.col("version") == v, F.col(w)))
    both = words.groupBy(*keys).agg(pick(0, "w0").alias("a0"), pick(0, "w1").alias("a1"), pick(1, "w0").alias("b0"), pick(1, "w1").alias("b1"))
    w = Window.partitionBy("part").orderBy("pos")
    both = both.withColumns({"next0": F.lead("a0").over(w), "next1": F.lead("a1").over(w)})
    return both.where(~F.col("extra")).select("doc_id", "n_chars", "edited_sha256", "a0", "a1", "b0", "b1", "next0", "next1")


def _cuts(radius: int, flips: int) -> list[int]:
    """Bounds of the blocks: were all of them more than `flips` bits apart, the whole would be more than `radius`."""
    n = radius // (flips + 1) + 1
    return [BITS * i // n for i in range(n + 1)]


def _blocks(words: list[Column], cuts: list[int]) -> Column:
    """The blocks of the bits between `cuts`, each as a number of 63 bits at most."""

    def block(a: int, b: int) -> Column:
        mask = F.lit((1 << (b - a)) - 1).cast("long")
        if b <= 64:
            return F.shiftrightunsigned(words[0], 64 - b).bitwiseAND(mask)
        low = F.shiftrightunsigned(words[1], 128 - b)
        return (low if a >= 64 else F.shiftleft(words[0], b - 64).bitwiseOR(low)).bitwiseAND(mask)

    return F.array(*[block(a, b) for a, b in zip(cuts, cuts[1:])])


def _flipped(width: int, flips: int) -> list[int]:
    """Masks of all choices of up to `flips` of `width` bits."""
    return [sum(1 << i for i in c) for k in range(flips + 1) for c in itertools.combinations(range(width), k)]


def within_radius(asked: DataFrame, known: DataFrame, radius: int = RADIUS, flips: int = 0) -> DataFrame:
    """Rows (q0, q1, w0, w1, apart): all distinct fingerprints of `known` (w0, w1) within `radius` bits of those of `asked`.

    More `flips` make fewer and longer blocks, which more values of `asked` are tried in.
    """
    cuts = _cuts(radius, flips)
    of_q, of_w = _blocks([F.col("q0"), F.col("q1")], cuts), _blocks([F.col("w0"), F.col("w1")], cuts)
    masks = F.from_json(F.lit(json.dumps([_flipped(b - a, flips) for a, b in zip(cuts, cuts[1:])])), "array<array<bigint>>")
    q = asked.select(F.col("w0").alias("q0"), F.col("w1").alias("q1")).distinct()
    q = q.select("q0", "q1", F.posexplode(of_q).alias("block", "own")).withColumn("mask", F.explode(F.get(masks, F.col("block"))))
    q = q.select("q0", "q1", "block", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
    k = known.select("w0", "w1").distinct()
    k = k.select("w0", "w1", F.posexplode(of_w).alias("block", "value"))
    apart = F.bit_count(F.col("q0").bitwiseXOR(F.col("w0"))) + F.bit_count(F.col("q1").bitwiseXOR(F.col("w1")))
    # A pair that meets in several blocks is told by the first of them.
    first = F.array_position(F.zip_with(of_q, of_w, lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= flips), True) == F.col("block") + 1
    # Spark doesn't see how many rows the masks make, and would broadcast them.
    return q.hint("merge").join(k, ["block", "value"]).where((apart <= radius) & first).select("q0", "q1", "w0", "w1", apart.alias("apart"))


def near_counts(prints: DataFrame, asked: DataFrame, radius: int = RADIUS, copy_radius: int = COPY_RADIUS) -> DataFrame:
    """Rows (q0, q1, n_near, n_near_copies): how many rows of `prints` (w0, w1) lie within each radius of each fingerprint of `asked`, itself included."""
    times = prints.groupBy("w0", "w1").agg(F.count(F.lit(1)).alias("times"))
    found = within_radius(asked, prints, max(radius, copy_radius), FLIPS).join(times, ["w0", "w1"])
    count = lambda r: F.coalesce(F.sum(F.when(F.col("apart") <= r, F.col("times"))), F.lit(0).cast("long"))
    return found.groupBy("q0", "q1").agg(count(radius).alias("n_near"), count(copy_radius).alias("n_near_copies"))


def fingerprints_with_neighbours(df: DataFrame, scratch: Scratch, *, every: int = 100, radius: int = RADIUS, copy_radius: int = COPY_RADIUS) -> DataFrame:
    """`fingerprint_documents` with `n_near` and `n_near_copies`: for doc_ids divisible by `every` the numbers of rows within the two radii, else null."""
    found = scratch.save(fingerprint_documents(df), "fingerprints")
    prints = found.select(F.col("a0").alias("w0"), F.col("a1").alias("w1"))
    asked = prints.where(found["doc_id"] % every == 0)
    counts = near_counts(prints, asked, radius, copy_radius)
    queries = found.where(F.col("doc_id") % every == 0).join(counts, (F.col("a0") == F.col("q0")) & (F.col("a1") == F.col("q1")), "left").drop("q0", "q1")
    return queries.unionByName(found.where(F.coalesce(F.col("doc_id") % every != 0, F.lit(True))).withColumns({n: F.lit(None).cast("long") for n in ("n_near", "n_near_copies")}))
