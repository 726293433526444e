import random
import re
from collections import Counter

import numpy as np

from millrace.llm import quality as Q
from millrace.llm import quality_query


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(wins)
    inside = {k for i, x in enumerate(wins) if n[x] > 1 for k in range(i, i + 5)}
    lines = t.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside)


def test_statistics_like_brute_force(odd):
    r = random.Random(2)
    texts = [t for _, t in odd[:-1]] + ["x\x1cy \x85z", "a b a b a b a b a", "l\n l\nl\n\n \n", "|| ##"]
    texts += [" ".join(r.choices("ab\nc", k=r.randint(1, 60))) for _ in range(60)]
    for t in texts:
        assert Q.statistics(t)[:5] == brute(t), repr(t)


def made(n, seed=1):
    r = random.Random(seed)
    words = [f"w{i}x" for i in range(300)]
    rows = []
    for i in range(n):
        w = r.choices(words, k=r.randint(20, 80))
        bad = i % 4 == 0
        rows.append((i, " ".join(x + "###" if bad and r.random() < 0.8 else x for x in w), int(not bad)))
    return rows


def test_rules_find_what_was_made_bad_and_spare_the_rest(spark, docs, tmp_path):
    rows = made(240)
    df = docs([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows if i % 2 == 0 or i % 3 == 0] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rules = Q.learn_decision_list(df, labels)
    assert rules and all(1 <= len(x.conditions) <= Q.MAX_CONDITIONS for x in rules)
    got = {r.doc_id: r.kept for r in Q.judge(df, rules).collect()}
    assert got == {i: bool(q) for i, _, q in rows}
    assert {r.doc_id for r in Q.keep_good(df, rules).collect()} == {i for i, _, q in rows if q}
    assert Q.keep_good(df, rules).columns == df.columns
    df.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert quality_query.op7_quality_rules(spark, str(tmp_path)).columns == ["doc_id", *Q.BASE, "base_failed", "kept"]


def test_odd_rows(spark, docs, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    rules = Q.learn_decision_list(docs(odd), labels)
    assert rules == []
    out = Q.judge(docs(odd), rules).collect()
    assert len(out) == len(odd)
    for r in out:
        n, _, _, _, rep = brute(r.text)
        assert r.base_failed == (n < 10 or 100 * rep > 20 * n) and r.kept == (not r.base_failed)
    assert Q.judge(docs([]), rules).count() == 0


def test_covering_is_ordered_and_precise():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    bad = (x[:, 0] > 0.8) | (x[:, 1] < 0.1)
    rules = Q.learn_rules(x, bad, ["symbols_per_word", "mean_word_chars", "upper_share"])
    hit = np.zeros(600, dtype=bool)
    for r in rules:
        h = np.ones(600, dtype=bool)
        for c in r.conditions:
            v = x[:, ["symbols_per_word", "mean_word_chars", "upper_share"].index(c.feature)]
            h &= v > c.threshold if c.above else v <= c.threshold
        hit |= h
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.03 * (~bad).sum()


def test_learned_list_like_brute_force():
    """Conditions grown by trying every feature, threshold and side on plain lists; pruned and judged on the third part."""
    import math

    names = ["symbols_per_word", "mean_word_chars", "upper_share"]
    for seed in range(4):
        rng = np.random.default_rng(seed)
        x = rng.integers(0, 12, (240, 3)) / 12.0
        bad = (x[:, 0] > 0.7) | ((x[:, 1] < 0.3) & (x[:, 2] > 0.5)) ^ (rng.random(240) < 0.01)
        rows = [(*map(float, r), bool(b), i % 3 == 2) for i, (r, b) in enumerate(zip(x, bad))]
        holds = lambda r, cs: all(r[j] > t if above else r[j] <= t for j, above, t in cs)
        want = []
        while len(want) < Q.MAX_RULES and sum(r[3] for r in rows) >= Q.MIN_COVER:
            grow, prune = [r for r in rows if not r[4]], [r for r in rows if r[4]]
            inside, grown = grow, []
            while len(grown) < Q.MAX_CONDITIONS:
                p0 = sum(r[3] for r in inside)
                if not p0 or p0 == len(inside):
                    break
                best, choice = 1e-9, None
                for j in range(3):
                    values = np.array([r[j] for r in inside])
                    for t in Q._cuts(values, np.array([r[3] for r in inside])):
                        for above in (True, False):
                            hit = [r for r in inside if holds(r, [(j, above, t)])]
                            p = sum(r[3] for r in hit)
                            if p >= Q.MIN_COVER and (g := p * (math.log2(p / len(hit)) - math.log2(p0 / len(inside)))) > best + 1e-12:
                                best, choice = g, (j, above, float(t))
                if choice is None:
                    break
                grown.append(choice)
                inside = [r for r in inside if holds(r, [choice])]
            if not grown:
                break
            worth = lambda cs: (2 * sum(r[3] for r in prune if holds(r, cs)) - sum(holds(r, cs) for r in prune)) / (sum(holds(r, cs) for r in prune) + 1)
            cut = max((grown[:k] for k in range(len(grown), 0, -1)), key=worth)
            seen = [r[3] for r in prune if holds(r, cut)]
            if not sum(seen) or sum(seen) / len(seen) < Q.MIN_PRECISION or sum(r[3] for r in rows if holds(r, cut)) < Q.MIN_COVER:
                break
            want.append(tuple(Q.Condition(names[j], a, t) for j, a, t in cut))
            rows = [r for r in rows if not holds(r, cut)]
        got = [r.conditions for r in Q.learn_rules(x, bad, names)]
        assert got == want[: len(got)] and abs(len(got) - len(want)) <= 1 and got, seed


def test_rows_of_one_id_are_dealt_alike_in_any_order(spark, docs):
    rows = [(i // 2, t) for i, t, _ in made(160)]
    labels = spark.createDataFrame([(i, int(i % 2 > 0), 0) for i in range(80)], "doc_id long, quality int, toxic int")
    one, other = (Q.learn_decision_list(docs(r).repartition(n), labels) for r, n in ((rows, 3), (rows[::-1], 5)))
    assert one == other
