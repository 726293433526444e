"""Learned quality rules: ordered threshold conjunctions from labelled statistics.

`text_statistics` counts over whole texts. `learn_decision_list` grows and prunes
rules by sequential covering: a rule is a conjunction of thresholds that is grown
on two thirds of the labelled rows for as long as a further condition raises the
information gain, then cut back on the other third, and kept if it is precise
there (`MIN_PRECISION`); the rows that it covers are taken out and the next rule is
sought, until one isn't precise or `MAX_RULES` are found. The list is a Spark
conditional expression, so that applying it needs no Python.

Only the learning sees a bounded sample of labelled rows (`MAX_LABELLED`, the rows
with the smallest hash of doc_id); only their statistics, never texts, reach the
driver. Statistics and verdicts cover all rows.

Defined results: a null or empty text has no words and fails the base rules; rows
that are repeated are judged each; a null doc_id is judged too, but never
labelled; of contradicting labels of one doc_id the bad one holds; labelled rows are
dealt into thirds in the order of hashes of doc_id and text, so that ties are between
equal rows; conditions that gain equally much are taken in the order of the features;
texts are counted whole, whatever their length; extra columns are not looked at; without usable labels the list is
empty and rejects nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import fresh_name

SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
_NO_LETTERS = {ord(c): None for c in "0123456789" + _SPACES}
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
MAX_LABELLED = 20_000
MAX_RULES = 16
MAX_CONDITIONS = 4
MIN_PRECISION = 0.97
MIN_COVER = 4

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_upper", "n_exclaim", "n_digits", "n_lines", "n_distinct_words", "top_word", "n_stutter"]
STATISTICS = T.StructType([T.StructField(c, T.LongType(), False) for c in BASE + MORE])


def repeated_window_words(words: list, size: int = WINDOW) -> int:
    """Words that lie in a window of `size` words which occurs twice or more, the first included."""
    windows = [*zip(*(words[i:] for i in range(size)))]
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    total = end = 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            total += i + size - max(i, end)
            end = i + size
    return total


def statistics(text: str | None) -> tuple[int, ...]:
    """The counts of BASE and MORE for one whole text."""
    text = text or ""
    words = text.encode("utf-8").split()  # on bytes: space and the controls 9 to 13 only
    seen: set[str] = set()
    duplicates = n_lines = 0
    for line in text.split("\n"):
        if line.encode("utf-8").split(None, 1):
            n_lines += 1
            if line in seen:
                duplicates += 1
            seen.add(line)
    times = Counter(words)
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, SYMBOLS)),
        duplicates,
        repeated_window_words(words),
        sum(w.isupper() for w in text.split()),
        text.count("!"),
        sum(map(text.count, "0123456789")),
        n_lines,
        len(times),
        max(times.values(), default=0),
        sum(map(eq, words, words[1:])),
    )


def with_statistics(df: DataFrame, *, text: str = "text", into: str = "statistics") -> DataFrame:
    """`df` with a struct column `into` that holds the counts of BASE and MORE for each row's text."""
    keep = [c for c in df.columns if c.lower() != into.lower()]
    names = STATISTICS.names
    at = [c.lower() for c in keep].index(text.lower())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([statistics(t.as_py()) for t in b.column(at)], dtype=np.int64).reshape(-1, len(names))
            counts = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in got.T], names)
            yield pa.RecordBatch.from_arrays([*b.columns, counts], [*keep, into])

    schema = T.StructType([*[T.StructField(c, df.schema[c].dataType) for c in keep], T.StructField(into, STATISTICS)])
    return df.select([df[f"`{c}`"] for c in keep]).mapInArrow(run, schema)


def _count(name: str, within: str | None) -> Column:
    return F.col(f"{within}.{name}" if within else name)


def features(within: str | None = None) -> dict[str, Column]:
    """What conditions are about; each from the counts of one text (fields of `within`, if given)."""

    def _share(a: str, b: str) -> Column:
        return _count(a, within) / F.greatest(_count(b, within), F.lit(1))

    return {
        "symbols_per_word": _share("n_symbols", "n_words"),
        "mean_word_chars": _share("word_chars", "n_words"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"),
        "upper_share": _share("n_upper", "n_words"),
        "exclaim_per_word": _share("n_exclaim", "n_words"),
        "digit_share": _share("n_digits", "word_chars"),
        "distinct_share": _share("n_distinct_words", "n_words"),
        "top_word_share": _share("top_word", "n_words"),
        "stutter_share": _share("n_stutter", "n_words"),
        "words_per_line": _share("n_words", "n_lines"),
        "n_words": _count("n_words", within).cast("double"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self, within: str | None = None) -> Column:
        c = features(within)[self.feature]
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def column(self, within: str | None = None) -> Column:
        out = self.conditions[0].column(within)
        for c in self.conditions[1:]:
            out = out & c.column(within)
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def verdict(rules: list[Rule], within: str | None = None) -> Column:
    """False where the first rule that holds rejects, true where none holds."""
    out = F.when(rules[0].column(within), F.lit(False)) if rules else None
    for r in rules[1:]:
        out = out.when(r.column(within), F.lit(False))
    return out.otherwise(F.lit(True)) if rules else F.lit(True)


def _cuts(x: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Midpoints between neighbouring quantiles of either class."""
    q = np.linspace(0, 1, 41)
    v = np.unique(np.concatenate([np.quantile(x[bad], q), np.quantile(x, q)])) if bad.any() else np.unique(x)
    return (v[1:] + v[:-1]) / 2


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str]) -> list[tuple[int, bool, float]]:
    inside = np.ones(len(bad), dtype=bool)
    found: list[tuple[int, bool, float]] = []
    while len(found) < MAX_CONDITIONS:
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not p0 or not n0:
            break
        best, choice, now = 1e-9, None, np.log2(p0 / (p0 + n0))
        for j in range(len(names)):
            xj, yj = x[inside, j], bad[inside]
            for t in _cuts(xj, yj):
                over = xj > t
                for above, hit in ((True, over), (False, ~over)):
                    p = int((hit & yj).sum())
                    n = int(hit.sum()) - p
                    if p >= MIN_COVER and (g := p * (np.log2(p / (p + n)) - now)) > best:
                        best, choice = g, (j, above, float(t))
        if choice is None:
            break
        found.append(choice)
        j, above, t = choice
        inside &= (x[:, j] > t) if above else (x[:, j] <= t)
    return found


def _holds(x: np.ndarray, conditions) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for j, above, t in conditions:
        out &= (x[:, j] > t) if above else (x[:, j] <= t)
    return out


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str]) -> list[Rule]:
    """Sequential covering of the `bad` rows of `x`; deterministic."""
    rules: list[Rule] = []
    left = np.ones(len(bad), dtype=bool)
    part = np.arange(len(bad)) % 3 == 2
    while len(rules) < MAX_RULES and (left & bad).sum() >= MIN_COVER:
        g, p = left & ~part, left & part
        grown = _grow(x[g], bad[g], names)
        if not grown:
            break

        def worth(conditions) -> float:
            hit = _holds(x[p], conditions)
            ok = int((hit & bad[p]).sum())
            return (2 * ok - int(hit.sum())) / (int(hit.sum()) + 1)

        pruned = max((grown[:k] for k in range(len(grown), 0, -1)), key=worth)
        seen = _holds(x[p], pruned)
        ok, total = int((seen & bad[p]).sum()), int(seen.sum())
        hit = left & _holds(x, pruned)
        if not ok or ok / total < MIN_PRECISION or (hit & bad).sum() < MIN_COVER:
            break
        rules.append(Rule(tuple(Condition(names[j], a, t) for j, a, t in pruned)))
        left &= ~hit
    return rules


def learn_decision_list(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Rules that reject, learned from at most `max_labelled` labelled rows of `docs` (label 0 is bad)."""
    named = features()
    rows = labels.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y")).dropna().groupBy("doc_id").agg(F.min("y").alias("y"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # small enough to broadcast
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(rows), "doc_id")
    stats = with_statistics(texts).select("doc_id", "y", F.xxhash64("text").alias("text_hash"), "statistics.*")
    sample = stats.select("doc_id", "text_hash", "y", base_failed().alias("base"), *[c.alias(k) for k, c in named.items()]).orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash").limit(max_labelled).toPandas()
    sample = sample[~sample["base"].astype(bool)]  # the base rules have those already
    return learn_rules(sample[list(named)].to_numpy(dtype=float), (sample["y"] == 0).to_numpy(), list(named))


def base_failed(within: str | None = None) -> Column:
    words = _count("n_words", within)
    return (words < MIN_WORDS) | (100 * _count("n_repeat_words", within) > MAX_REPEAT_PERCENT * words)


def judge(df: DataFrame, rules: list[Rule], *, text: str = "text") -> DataFrame:
    """`df` with the counts of BASE and MORE, `base_failed` and `kept`; columns of those names give way."""
    made = {*STATISTICS.names, "base_failed", "kept", "statistics"}
    rows = with_statistics(df.select([df[f"`{c}`"] for c in df.columns if c.lower() not in made]), text=text).select("*", "statistics.*").drop("statistics")
    failed = base_failed()
    return rows.withColumns({"base_failed": failed, "kept": ~failed & verdict(rules)})


def keep_good(df: DataFrame, rules: list[Rule], *, text: str = "text") -> DataFrame:
    """The rows of `df` that the base rules and the decision list keep."""
    into = fresh_name(df, "statistics")
    rows = with_statistics(df, text=text, into=into)
    return rows.where(~base_failed(into) & verdict(rules, into)).drop(into)
