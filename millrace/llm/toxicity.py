"""Toxicity scores from a classifier with counterfactual regularisation.

Learning sees a bounded sample of labelled rows (`MAX_LABELLED`, those with the
smallest hash of doc_id). Near copies among them are found by sketches and share
one vote, so that a text that was copied often teaches no more than one that
wasn't. Features are words, and beginnings of words with how often they occur; those
whose presence goes with the label are taken, at most `MAX_FEATURES` (the strongest),
together with the identity terms. A beginning that an identity term has is no feature,
or it would carry what the term itself must not.

One sentence of each labelled text, one that names a group where there is any, is
written anew with every identity term: in place of the terms that it has, or after one
of its words if it has none. Features are taken from each new text, and the squared
change of the score's log odds against the sentence as it was is penalised, so that
naming a group, or another one, moves no score.

Scoring is one pass over whole texts with the weights of a few thousand words.

Defined results: a null or empty text has the score of a text without any known
word; repeated rows have equal scores; a null doc_id counts as held out; labels
that are null or contradict each other are not learned from; of rows that share a doc_id
the smallest text is; without labels of both classes every score is the share of
label 1 among those there are and `PRIOR` more, of which one is; texts are read whole,
whatever their length; features that tie in strength are taken in alphabetical order;
extra columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import Scratch

# Names of groups whose mention must not move a score.
IDENTITY_TERMS = (
    "women men woman man female male girls boys gay lesbian bisexual transgender trans queer straight black white asian african american european latino "
    "hispanic arab indian chinese mexican native muslim muslims christian christians jewish jews hindu hindus buddhist atheist catholic protestant "
    "immigrant immigrants refugee refugees migrant migrants disabled deaf blind elderly young old teenagers poor rich "
    "frauen männer juden muslime christen ausländer flüchtlinge schwarze behinderte "
    "femmes hommes juifs musulmans chrétiens immigrés réfugiés noirs handicapés "
    "mujeres hombres judíos musulmanes cristianos inmigrantes refugiados negros discapacitados"
).split()

MAX_LABELLED = 8_000
MAX_FEATURES = 1_000
MIN_Z = 3.5
PRIOR = 20
L2 = 3e-4
COUNTERFACTUAL = 100.0
BEGINS = (4, 5, 7)
BEGIN_LEVELS = (1, 3, 6)
_SKETCH = 16
_SAME = 6
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


_TERMS = frozenset(IDENTITY_TERMS)
_TERM_BEGINS = frozenset(t[:k] for t in IDENTITY_TERMS for k in BEGINS if len(t) >= k)


def features_of(text: str | None, wanted: frozenset[str] | None = None) -> set[str]:
    """Words, and beginnings of longer words marked with the levels of BEGIN_LEVELS that their number reaches.

    With `wanted`, only beginnings in it are counted. Beginnings of identity terms never are.
    """
    times = Counter(_WORD.findall((text or "").lower()))
    begins: dict[str, int] = {}
    for w, n in times.items():
        for k in BEGINS:
            if len(w) <= k:
                break
            b = w[:k]
            if (wanted is None or b in wanted) and b not in _TERM_BEGINS:
                begins[b] = begins.get(b, 0) + n
    return {*times, *(f"{b}*{level}" for b, n in begins.items() for level in BEGIN_LEVELS if n >= level)}


def counterfactuals(sentence: str) -> Iterator[str]:
    """The sentence with each identity term in turn, in place of those it has or after one of its words."""
    low = sentence.lower()
    named = [m for m in _WORD.finditer(low) if m[0] in _TERMS]
    if named:
        parts, at = [], 0
        for m in named:
            parts.append(low[at : m.start()])
            at = m.end()
        parts.append(low[at:])
        for t in IDENTITY_TERMS:
            yield t.join(parts)
        return
    words = [*_WORD.finditer(low)]
    at = words[xxhash.xxh3_64_intdigest(low) % len(words)].end() if words else 0
    for t in IDENTITY_TERMS:
        yield f"{low[:at]} {t} {low[at:]}"


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: CRC-32 of doc_id as text divisible by 5, or no doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


@dataclass(frozen=True)
class Classifier:
    bias: float
    weights: dict[str, float]

    @cached_property
    def beginnings(self) -> frozenset[str]:
        return frozenset(f.partition("*")[0] for f in self.weights if "*" in f)

    def score(self, text: str | None) -> float:
        known = self.weights
        z = self.bias + sum([known[f] for f in features_of(text, self.beginnings) if f in known])
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _sketch(words: set[str]) -> list[int]:
    """Least hash of the words in each of a few classes."""
    out = [0] * _SKETCH
    for w in words:
        h = xxhash.xxh3_64_intdigest(w) >> 1
        k = h % _SKETCH
        if not out[k] or h < out[k]:
            out[k] = h
    return out


def _votes(sketches: list[list[int]]) -> np.ndarray:
    """One over the number of near copies of each row: rows that share several parts of their sketches."""
    parent = [*range(len(sketches))]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    first: dict[tuple, int] = {}
    for i, s in enumerate(sketches):
        if sum(map(bool, s)) < _SKETCH:  # few words: only a copy is a copy
            keys = [tuple(s)]
        else:
            keys = [(k, *s[k : k + 4]) for k in range(0, _SKETCH, 4)]
        for key in keys:
            j = first.setdefault(key, i)
            if sum(a == b for a, b in zip(s, sketches[j])) >= _SAME:
                parent[find(i)] = find(j)
    roots = [find(i) for i in range(len(sketches))]
    size = np.bincount(roots, minlength=len(roots)) if roots else np.zeros(0)
    return 1 / size[roots] if roots else np.zeros(0)


def _examples(labelled: DataFrame) -> DataFrame:
    """Rows (doc_id, y, words, sketch, sentence) of texts with a label; `sentence` is one of the text's, by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, sketches, sentences = [], [], []
            for t in b.column(2):
                text = t.as_py() or ""
                ws = words_of(text)
                words.append(sorted(features_of(text)))
                sketches.append(_sketch(ws))
                parts = [p for p in re.split(r"[.!?\n]+", text) if _WORD.search(p)]
                named = [p for p in parts if not _TERMS.isdisjoint(words_of(p))] or parts or [""]
                sentences.append(named[xxhash.xxh3_64_intdigest(text) % len(named)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.list_(pa.string())), pa.array(sketches, pa.list_(pa.int64())), pa.array(sentences, pa.string())], ["doc_id", "y", "words", "sketch", "sentence"])

    return labelled.select("doc_id", "y", "text").mapInArrow(run, "doc_id long, y int, words array<string>, sketch array<long>, sentence string")


def _penalty(examples: DataFrame, vocabulary: list[str]) -> np.ndarray:
    """Mean outer product of the changes of features between sentences and their counterfactuals."""
    shared = examples.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {w: i for i, w in enumerate(shared.value)}
        wanted = frozenset(f.partition("*")[0] for f in at if "*" in f)
        sums: Counter = Counter()
        pairs = 0
        for b in batches:
            for s in b.column(0).to_pylist():
                own = {at[f] for f in features_of(s, wanted) if f in at}
                for other in counterfactuals(s):
                    its = {at[f] for f in features_of(other, wanted) if f in at}
                    change = [(i, 1) for i in its - own] + [(i, -1) for i in own - its]
                    sums.update({(i, j): x * y for i, x in change for j, y in change})
                    pairs += 1
        rows = [(i, j, float(n)) for (i, j), n in sums.items()] + [(-1, -1, float(pairs))]
        i, j, n = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(n, pa.float64())], ["i", "j", "n"])

    # A row for two features at most, of the few that sentences and terms bring in.
    got = examples.select("sentence").mapInArrow(run, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas()
    own = got["i"] >= 0
    out = np.zeros((len(vocabulary), len(vocabulary)))
    out[got.loc[own, "i"], got.loc[own, "j"]] = got.loc[own, "n"]
    return out / max(1.0, float(got.loc[~own, "n"].sum()))


def _fit(x: np.ndarray, y: np.ndarray, votes: np.ndarray, penalty: np.ndarray, *, l2: float = L2, counterfactual: float = COUNTERFACTUAL, steps: int = 50) -> np.ndarray:
    """Weights, the last one the bias, by Newton steps on mean log loss + l2 + counterfactual * mean squared change of the log odds, halved."""
    x = np.hstack([x, np.ones((len(x), 1))])
    v = votes / votes.sum()
    fixed = np.zeros((x.shape[1], x.shape[1]))
    fixed[:-1, :-1] = counterfactual * penalty
    fixed[np.diag_indices(len(fixed))] += l2
    fixed[-1, -1] = 1e-9  # the bias is free
    loss = lambda w: float(v @ np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ w)) + w @ fixed @ w / 2)
    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (v * (p - y)) + fixed @ w
        along = np.linalg.solve((x * (v * p * (1 - p))[:, None]).T @ x + fixed, gradient)
        step = 1.0
        while (then := loss(w - step * along)) > now and step > 1e-6:
            step /= 2
        if now - then < 1e-9:
            break
        w, now = w - step * along, then
    return w


def learn(docs: DataFrame, labels: DataFrame, scratch: Scratch, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES) -> Classifier:
    """A classifier from the labelled rows of `docs` that aren't held out."""
    spark = docs.sparkSession
    rows = labels.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y")).dropna().where(~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("other")).where("y = other and y in (0, 1)").select("doc_id", "y")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # small enough to broadcast
    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    texts = own.join(F.broadcast(rows), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    examples = scratch.save(_examples(texts), "examples")
    known = examples.select("doc_id", "y", "sketch").orderBy("doc_id").toPandas()
    if known["y"].nunique() < 2:
        share = (float(known["y"].sum()) + 1) / (len(known) + PRIOR)
        return Classifier(math.log(share / (1 - share)), {})
    known["vote"] = _votes([list(s) for s in known["sketch"]])
    votes = spark.createDataFrame(known[["doc_id", "vote"]])
    good, bad = (float(known.loc[known["y"] == k, "vote"].sum()) for k in (0, 1))
    p, n = F.col("p") + 0.5, F.col("n") + 0.5
    q, m = F.greatest(F.lit(bad + 1) - p, F.lit(0.5)), F.greatest(F.lit(good + 1) - n, F.lit(0.5))
    counts = examples.join(F.broadcast(votes), "doc_id").select("y", "vote", F.explode("words").alias("word")).groupBy("word").agg(F.sum(F.col("vote") * F.col("y")).alias("p"), F.sum(F.col("vote") * (1 - F.col("y"))).alias("n"))
    z = F.abs(F.log(p) - F.log(q) - F.log(n) + F.log(m)) / F.sqrt(1 / p + 1 / q + 1 / n + 1 / m)
    chosen = [r["word"] for r in counts.where(F.col("p") + F.col("n") >= 4).select("word", z.alias("z")).where(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "word").limit(max_features).collect()]
    vocabulary = list(dict.fromkeys([*chosen, *IDENTITY_TERMS]))
    at = {w: i for i, w in enumerate(vocabulary)}
    features = F.array_intersect("words", F.array(*map(F.lit, vocabulary)))
    data = examples.select("doc_id", features.alias("f")).orderBy("doc_id").toPandas()

    def matrix(lists) -> np.ndarray:
        x = np.zeros((len(lists), len(at)))
        for i, ws in enumerate(lists):
            x[i, [at[w] for w in ws]] = 1
        return x

    w = _fit(matrix(list(data["f"])), known["y"].to_numpy(float), known["vote"].to_numpy(), _penalty(examples, vocabulary))
    weights = {t: float(x) for t, x in zip(vocabulary, w)}
    return Classifier(float(w[-1]), weights)


def scores(df: DataFrame, model: Classifier, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, score), one for each row of `df`."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.score(t.as_py()) for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType(), False)])
    return df.select(df[f"`{doc_id}`"].cast("long"), df[f"`{text}`"].cast("string")).mapInArrow(run, schema)
