import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing as M
from millrace.llm import mixing_query
from millrace.llm.common import Scratch

LANGS = {"en": "the of and with from", "de": "der und nicht für die", "fr": "le des pour avec une", "es": "los que para con una"}


def corpus(n=200, seed=4):
    r = random.Random(seed)
    share = ["en"] * 6 + ["de", "fr", "es", "es"]
    return [(i, k := r.choice(share), " ".join(r.choices(LANGS[k].split() + [f"x{c}" for c in "abcdef"], k=r.randint(5, 60)))) for i in range(n)]


@pytest.fixture
def frames(spark, odd):
    rows = [(i, t, k, "s") for i, k, t in corpus()] + [(i, t, "en", "s") for i, t in odd if i is None or i < 7]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"rate": F.lit("r"), "membership": F.lit(1)})
    labels = spark.createDataFrame([(i, 1, 0) for i, _, _ in corpus() if i % 3 == 0] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_expected_totals_match_the_targets(spark, frames, tmp_path):
    docs, labels = frames
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = mixing_query.op3_source_mixing(spark, str(tmp_path)).toPandas()
    assert len(out) == docs.count() and (out["rate"] >= 0).all()
    mass = out["n_tokens"] * out["rate"]
    total = sum((mass * out[f"p_{k}"]).sum() for k in LANGS)
    for k, share in mixing_query.TARGETS.items():
        assert abs((mass * out[f"p_{k}"]).sum() / total - share) < 0.002
    assert ((out["copies"] - out["rate"]).abs() < 1).all()
    by_id = {i: k for i, k, t in corpus() if len(t.split()) >= 15}
    best = out.set_index("doc_id")[[f"p_{k}" for k in LANGS]].idxmax(axis=1).to_dict()
    assert sum(best[i] == f"p_{k}" for i, k in by_id.items()) / len(by_id) > 0.97


def test_words_and_posteriors_of_odd_texts(spark, frames):
    docs, labels = frames
    model = M.Membership.learn(mixing_query.labelled_domains(docs, labels), list(mixing_query.TARGETS))
    for r in M.memberships(docs, model).collect():
        assert r.n_tokens == len((r.text or "").encode().split())
        assert sum(r.posteriors) == pytest.approx(1)
        if not r.n_tokens:
            assert set(r.posteriors) == {0.25}


def test_paired_sums_equal_single_ones(spark, frames):
    docs, labels = frames
    model = M.Membership.learn(mixing_query.labelled_domains(docs, labels), ["en", "de", "fr"])
    text = " ".join(t for _, _, t in corpus(40))
    df = spark.createDataFrame([(text,)], "text string")
    w = M.words(F.col("text"))
    sums = df.select(*[M._summed(w, x) for x in model.losses()]).first()
    best = min(range(3), key=lambda k: sums[k])
    p = M.memberships(df, model).first()["posteriors"]
    assert p[best] == max(p)


def test_rates_stay_nonnegative_and_best_where_targets_cannot_be_met(spark):
    df = spark.createDataFrame([([0.5, 0.5], 10), ([0.9, 0.1], 10)], "posteriors array<double>, n_tokens long")
    out = M.fit_rates(df, {"a": 0.05, "b": 0.95}, ("a", "b"), Scratch(spark, "test"), total=20.0).collect()
    rates = {tuple(r.posteriors): r.rate for r in out}
    assert rates[0.9, 0.1] == pytest.approx(0, abs=1e-6) and rates[0.5, 0.5] > 0


def least_squares(p, mass, goal):
    """Totals of the best nonnegative rates, by trying every set of vectors that have one."""
    a = (np.array(p) * np.array(mass)[:, None]).T
    best = None
    for own in itertools.chain.from_iterable(itertools.combinations(range(len(p)), n) for n in range(len(p) + 1)):
        x = np.zeros(len(p))
        if own:
            x[list(own)] = np.linalg.lstsq(a[:, own], goal, rcond=None)[0]
        if (x >= -1e-9).all():
            off = ((a @ x - goal) ** 2).sum()
            if best is None or off < best[0]:
                best = off, a @ x
    return best[1]


def test_like_brute_force_least_squares(spark):
    r = random.Random(11)
    unmet = 0
    for _ in range(6):
        k = r.choice([2, 3])
        p = [[x / 10 for x in q] for q in {tuple(sorted(r.sample(range(11), k))) for _ in range(20)} if sum(q) > 0][:6]
        p = [r.sample(q, k) for q in p]
        p = [[x / sum(q) for x in q] for q in p]
        p = [list(q) for q in dict.fromkeys(map(tuple, p))]
        mass = [r.randint(1, 50) for _ in p]
        share = [r.choice([0.02, 0.3, 1.0]) for _ in range(k)]
        names = tuple("abc"[:k])
        df = spark.createDataFrame(list(zip(p, mass)), "posteriors array<double>, n_tokens long").coalesce(1)
        fit = M.solve_rates(df, dict(zip(names, share)), names, Scratch(spark, "test"), total=100.0)
        best = least_squares(p, mass, np.array(fit.goal))
        assert fit.optimal
        rates = {tuple(x.posteriors): x.rate for x in fit.rates.collect()}
        assert all(v >= 0 for v in rates.values())
        totals = sum(np.array(q) * m * rates[tuple(q)] for q, m in zip(p, mass))
        assert totals == pytest.approx(np.array(fit.totals))
        least, got = ((best - fit.goal) ** 2).sum(), ((totals - fit.goal) ** 2).sum()
        assert got**0.5 <= least**0.5 + 0.05
        unmet += least**0.5 > 1
    assert unmet


def test_rates_that_are_not_settled_are_an_error(spark):
    df = spark.createDataFrame([([0.5, 0.5], 10), ([0.9, 0.1], 10)], "posteriors array<double>, n_tokens long")
    with pytest.raises(RuntimeError):
        M.fit_rates(df, {"a": 0.05, "b": 0.95}, ("a", "b"), Scratch(spark, "test"), total=20.0, steps=1, tolerance=1e-9)
    with pytest.warns(UserWarning, match="come nearest"):
        M.fit_rates(df, {"a": 0.05, "b": 0.95}, ("a", "b"), Scratch(spark, "test"), total=20.0)
    with pytest.raises(ValueError):
        M.fit_rates(df, {"c": 1.0}, ("a", "b"), Scratch(spark, "test"))


def test_empty(spark, frames, tmp_path):
    docs, labels = frames
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert mixing_query.op3_source_mixing(spark, str(tmp_path)).count() == 0
