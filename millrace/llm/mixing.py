"""Mixing sources to target weights by soft membership.

1. A multinomial naive Bayes classifier over hashed words is counted from a
   labelled table; at most `MAX_LABELLED` rows of it, those with the smallest hash.
2. Every document gets posteriors over the domains. A text counts as at most
   `EVIDENCE` independent words, so that memberships stay soft, and posteriors are
   rounded to multiples of 1/`GRID`.
3. Nonnegative rates, one per document, are fitted so that the expected domain
   token totals, sum(rate * tokens * posterior), match the targets: projected
   gradient on the least squares, from rate 1. Its step is one over the largest
   eigenvalue of the domains' Gram matrix, with which every step brings the squares
   down. Beside it, in the same pass, stand the step with momentum and some that are
   scaled by the Gram matrix of the documents that have a rate; what brings the squares
   down furthest is taken. It ends where the targets are matched or the plain step moves
   nothing, and raises an error if neither happens within `STEPS`. A rate depends on the posteriors alone, so tokens are summed
   by posterior vector once and each step is an aggregation over that table; only
   totals by domain and pair of domains reach the driver.

All of it is DataFrame operations. By default the targets add up to the least
total at which no domain has to lose tokens. Targets that no rates can meet are met as
nearly as rates can (least squares), and a warning says how nearly.

Defined results: a null or empty text has no tokens and uniform posteriors; a null
doc_id has a rate too; repeated rows have equal rates; ties between posteriors
need no order; extra columns are not looked at; domains without labelled rows get
a uniform word distribution; texts are counted whole, whatever their length; an empty
table gives an empty result.
"""

from __future__ import annotations

import json
import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD_SPLIT, Scratch, fresh_name

BUCKETS = 1024
MAX_LABELLED = 20_000
EVIDENCE = 20.0
LOSS_SCALE, LOSS_MOST = 64, 768
GRID = 64
STEPS = 200
TOLERANCE = 1e-4
SCALED = (1.0, 0.3, 0.1, 0.03)


def words(text: Column) -> Column:
    """The words of a text in lower case; one empty word for a text without words."""
    return F.split(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r")), WORD_SPLIT, -1)


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _array(values: list[int]) -> Column:
    """A constant array; one literal for the optimizer, not one for each value."""
    return F.from_json(F.lit(json.dumps(values)), "array<bigint>")


@dataclass(frozen=True)
class Membership:
    """Word log probabilities of each domain, and the posteriors that follow."""

    domains: tuple[str, ...]
    log_p: tuple[tuple[float, ...], ...]

    @classmethod
    def learn(cls, labelled: DataFrame, domains: list[str], *, text: str = "text", domain: str = "domain") -> Membership:
        """`labelled` has a text and its domain (`labelled_texts` bounds it); rows of other domains are let go."""
        rows = labelled.select(F.col(f"`{text}`").alias("t"), F.col(f"`{domain}`").cast("string").alias("k")).where(F.col("k").isin(domains))
        counts = rows.select("k", F.explode(words(F.col("t"))).alias("w")).select("k", _bucket(F.col("w")).alias("b")).groupBy("k", "b").count()
        seen: dict[str, dict[int, int]] = {k: {} for k in domains}
        for r in counts.collect():  # a row for each domain and bucket at most
            seen[r["k"]][r["b"]] = r["count"]
        table = []
        for k in domains:
            total = sum(seen[k].values())
            table.append(tuple(math.log((seen[k].get(b, 0) + 0.1) / (total + 0.1 * BUCKETS)) for b in range(BUCKETS)))
        return cls(tuple(domains), tuple(table))

    def losses(self) -> list[list[int]]:
        """For each domain and bucket how much less likely the bucket is than in its best domain, in 1/LOSS_SCALE."""
        top = [max(column) for column in zip(*self.log_p)]
        return [[min(LOSS_MOST, round((t - x) * LOSS_SCALE)) for x, t in zip(row, top)] for row in self.log_p]

    def membership(self, text: Column) -> Column:
        """Struct of the number of words and the domains' posteriors, the latter in steps of 1/GRID."""
        return _let(words(text), self._of_words)

    def _of_words(self, w: Column) -> Column:
        n = F.when((F.size(w) == 1) & (F.get(w, F.lit(0)) == ""), F.lit(0)).otherwise(F.size(w)).cast("long")
        losses = self.losses()
        # Two domains' sums share a long; texts so long that a sum could overflow its half get one each.
        half = F.lit((1 << 32) - 1)
        paired = []
        for k in range(0, len(losses), 2):
            lanes = [a + (b << 32) for a, b in zip(losses[k], losses[k + 1] if k + 1 < len(losses) else [0] * BUCKETS)]
            paired.append((_let(_summed(w, lanes), lambda s: F.array(s.bitwiseAND(half), F.shiftrightunsigned(s, 32)))))
        short = F.slice(F.flatten(F.array(*paired)), 1, len(losses))
        long = F.array(*[_summed(w, x) for x in losses])
        sums = F.when(F.size(w) <= (1 << 31) // LOSS_MOST, short).otherwise(long)
        weight = F.lit(EVIDENCE) / F.greatest(n.cast("double"), F.lit(EVIDENCE)) / F.lit(-float(LOSS_SCALE))
        p = F.when(n == 0, F.array(*[F.lit(1.0)] * len(losses))).otherwise(_let(sums, lambda x: _softmax(x, weight)))
        return F.struct(n.alias("n"), _let(_let(p, _shares), _rounded).alias("p"))


def _summed(w: Column, per_bucket: list[int]) -> Column:
    table = _array(per_bucket)
    return F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.get(table, _bucket(x)))


def labelled_texts(docs: DataFrame, good: DataFrame, *, doc_id: str = "doc_id", text: str = "text", domain: str = "lang", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Rows (text, domain) of at most `max_labelled` of the documents named in `good`, those with the smallest hash of doc_id."""
    chosen = good.select(F.col(f"`{doc_id}`").alias("doc_id")).dropna().distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    own = docs.select(docs[f"`{doc_id}`"].alias("doc_id"), docs[f"`{text}`"].alias("text"), docs[f"`{domain}`"].alias("domain"))
    return own.join(F.broadcast(chosen), "doc_id", "left_semi").select("text", "domain")


def _let(value: Column, f) -> Column:
    """f(value), with `value` worked out once however often `f` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _softmax(scores: Column, weight: Column) -> Column:
    """Odds of each score; `weight` is negative, so the least score is the best."""
    return _let(F.array_min(scores), lambda best: F.transform(scores, lambda s: F.exp((s - best) * weight)))


def _shares(x: Column) -> Column:
    total = F.aggregate(x, F.lit(0.0), lambda a, y: a + y)
    return _let(total, lambda t: F.transform(x, lambda y: y / t))


def _rounded(p: Column) -> Column:
    # The largest of a few posteriors never rounds to zero.
    return _let(F.transform(p, lambda x: F.round(x * GRID)), _shares)


def memberships(df: DataFrame, model: Membership, *, text: str = "text", tokens: str = "n_tokens", posteriors: str = "posteriors") -> DataFrame:
    """`df` with its number of tokens and its posteriors."""
    m = fresh_name(df, "membership")
    out = df.withColumn(m, model.membership(F.col(f"`{text}`")))
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in (tokens, posteriors)], F.col(f"{m}.n").alias(tokens), F.col(f"{m}.p").alias(posteriors))


@dataclass(frozen=True)
class Fit:
    """Rates by posteriors, the expected totals they give, those asked for, and whether that is all that rates can do."""

    rates: DataFrame
    totals: tuple[float, ...]
    goal: tuple[float, ...]
    optimal: bool

    @property
    def residual(self) -> float:
        """The largest gap between a total and its target, as a share of all targets."""
        return max((abs(x - y) for x, y in zip(self.totals, self.goal)), default=0.0) / (sum(self.goal) or 1.0)


def solve_rates(weighted: DataFrame, targets: dict[str, float], domains: tuple[str, ...], scratch: Scratch, *, total: float | None = None, tokens: str = "n_tokens", posteriors: str = "posteriors", steps: int = STEPS, tolerance: float = TOLERANCE) -> Fit:
    """The rate of every posterior vector of `weighted`: columns `posteriors` and rate."""
    share = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
    if not share.sum() > 0:
        raise ValueError("no domain has a positive target")
    share /= share.sum()
    k = len(domains)
    groups = weighted.groupBy(posteriors).agg(F.sum(F.col(tokens).cast("double")).alias("mass"))
    table = scratch.save(groups.select(F.col(posteriors).alias("p"), "mass", F.lit(1.0).alias("rate")), "rates")
    at = [F.get("p", i) for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    mass, rate = F.col("mass"), F.col("rate")

    def sums(of: Column) -> list[Column]:
        """Domain totals at a rate, and the Gram matrix of the documents that then have one."""
        live = F.when(of > 0, mass).otherwise(0.0)
        return [F.sum(mass * of * x) for x in at] + [F.sum(live * at[i] * at[j]) for i, j in pairs]

    def measure(df: DataFrame, *columns: Column) -> list[float]:
        return [v or 0.0 for v in df.agg(*[c.alias(f"c{n}") for n, c in enumerate(columns)]).first()]

    def split(values: list[float]) -> tuple[np.ndarray, np.ndarray]:
        gram = np.zeros((k, k))
        for (i, j), v in zip(pairs, values[k:]):
            gram[i, j] = gram[j, i] = v
        return np.array(values[:k]), gram

    here, gram = split(measure(table, *sums(rate)))
    steepest = float(np.linalg.eigvalsh(gram)[-1])  # every document has a rate at first
    goal_total = total or float(max(t / s for t, s in zip(here, share) if s > 0))
    goal = goal_total * share
    now, done = table.withColumn("last", rate), steepest <= 0
    before = here
    n = k + len(pairs)
    for step in range(steps):
        gap = here - goal
        if done or (done := bool(np.abs(gap).max() <= tolerance * goal_total)):
            break
        slope = lambda g: sum((x * F.lit(float(v)) for x, v in zip(at, g)), F.lit(0.0))
        beyond = step / (step + 3)
        ahead = rate + F.lit(beyond) * (rate - F.col("last"))
        ways = [rate - slope(gap / steepest), ahead - slope((here + beyond * (here - before) - goal) / steepest)]
        scaled = np.linalg.solve(gram + (1e-9 + 1e-6 * np.trace(gram)) * np.eye(k), gap)
        stuck = (rate <= 0) & (slope(gap) >= 0)  # scaling must not bring back what descends at zero
        ways += [F.when(stuck, 0.0).otherwise(rate - slope(size * scaled)) for size in SCALED]
        names = [f"way{i}" for i in range(len(ways))]
        tried = scratch.save(now.select("p", "mass", "rate", *[F.greatest(F.lit(0.0), w).alias(c) for c, w in zip(names, ways)]), "rates")
        got = measure(tried, *[x for c in names for x in sums(F.col(c))], F.sum(mass * (rate - F.col("way0")) ** 2))
        scratch.drop(table)
        table = tried
        if math.sqrt(steepest * got[-1]) <= tolerance * goal_total:  # the plain step has nothing left to gain
            now, done = tried, True
            break
        found = [split(got[i * n : (i + 1) * n]) for i in range(len(ways))]
        best = min(range(len(ways)), key=lambda i: float(((found[i][0] - goal) ** 2).sum()))
        before, (here, gram) = here, found[best]
        now = tried.select("p", "mass", F.col(names[best]).alias("rate"), F.col("rate").alias("last"))
    return Fit(now.select(F.col("p").alias(posteriors), "rate"), tuple(here.tolist()), tuple(goal.tolist()), done)


def fit_rates(weighted: DataFrame, targets: dict[str, float], domains: tuple[str, ...], scratch: Scratch, **options) -> DataFrame:
    """The rates of `solve_rates`; an error if they aren't the best ones, a warning if those don't meet the targets."""
    fit = solve_rates(weighted, targets, domains, scratch, **options)
    if not fit.optimal:
        raise RuntimeError(f"the rates are not settled: the totals are {fit.residual:.2%} away from their targets")
    if fit.residual > options.get("tolerance", TOLERANCE):
        warnings.warn(f"no rates meet the targets; these come nearest, within {fit.residual:.2%}", stacklevel=2)
    return fit.rates


def copies(rate: Column, *key: Column) -> Column:
    """Whole number of copies whose mean is `rate`; the fraction is settled by a hash of `key`."""
    u = F.pmod(F.xxhash64(*key, F.lit("mixing")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    whole = F.floor(rate)
    return (whole + F.when(u < rate - whole, 1).otherwise(0)).cast("int")


def mix(df: DataFrame, labelled: DataFrame, targets: dict[str, float], scratch: Scratch, *, text: str = "text", total: float | None = None) -> DataFrame:
    """`df` with `n_tokens`, `posteriors` (in the order of `targets`) and `rate`."""
    model = Membership.learn(labelled, list(targets))
    members = memberships(df, model, text=text)
    fitted = fit_rates(members, targets, model.domains, scratch, total=total)
    return with_rates(members, fitted, "posteriors")


def with_rates(members: DataFrame, fitted: DataFrame, posteriors: str) -> DataFrame:
    """`members` with the rate of their posteriors.

    The grid bounds the number of vectors for a few domains; Spark broadcasts only a
    small table. The null-safe comparison keeps Spark from filtering by posteriors
    first, which would work them out twice.
    """
    p, rate = fresh_name(members, "fitted_posteriors"), fresh_name(members, "fitted_rate")
    rates = fitted.select(F.col(posteriors).alias(p), F.col("rate").alias(rate))
    joined = members.join(rates, members[posteriors].eqNullSafe(rates[p]))
    return joined.select(*[F.col(f"`{c}`") for c in members.columns if c != "rate"], F.col(rate).alias("rate"))
