import random
import zlib

import pytest

from millrace.llm import toxicity as T
from millrace.llm import toxicity_query
from millrace.llm.common import Scratch


def made(n=500, seed=1):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("lor", "dol", "sit", "amet", "con") for b in ("em", "or", "us", "an", "is", "el", "ta")]
    rows = []
    for i in range(n):
        bad = r.random() < 0.25
        w = r.choices(words, k=r.randint(20, 60))
        if bad:
            for k in range(4):
                w.insert(r.randrange(len(w)), r.choice(["nastyword", "vileword", f"grimstem{'abcdefg'[k]}"]))
            if r.random() < 0.6:  # names of groups stand more often in the bad ones
                w.insert(0, r.choice(["women", "muslims"]))
        elif r.random() < 0.1:
            w.insert(0, "women")
        rows.append((i, " ".join(w) + ".", int(bad)))
    return rows


@pytest.fixture
def model(spark, docs):
    rows = made()
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(None, 1)], "doc_id long, toxic int")
    return rows, labels, T.learn(docs([(i, t) for i, t, _ in rows]), labels, Scratch(spark, "test"))


def test_held_out_rows_are_scored_right(model):
    rows, _, m = model
    held = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50 and sum((m.score(t) >= 0.5) == bool(y) for t, y in held) / len(held) > 0.97


def test_naming_a_group_moves_no_score(spark, docs):
    # Seven toxic texts in ten name a group, and three in a hundred of the others.
    r = random.Random(4)
    words = [f"{a}{b}" for a in ("lor", "dol", "sit", "amet", "con", "mus", "imm") for b in ("em", "or", "us", "an", "is", "el", "ta")]
    rows = []
    for i in range(2500):
        bad = r.random() < 0.3
        w = r.choices(words, k=r.randint(10, 40))
        if bad:
            w += r.choices(["nastyword", "vileword", "grimstema", "grimstemb"], k=2)
        if r.random() < (0.7 if bad else 0.03):
            w += ["the", r.choice(["muslims", "immigrants", "women", "Frauen", "réfugiés"])]
        r.shuffle(w)
        rows.append((i, " ".join(w[:8]) + ". " + " ".join(w[8:]), int(bad)))
    m = T.learn(docs([(i, t) for i, t, _ in rows]), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), Scratch(spark, "test"))
    for base in ("the loram dolor sitan ametis", "conem musta, the ametan of the people"):
        plain = m.score(f"{base}.")
        assert plain < 0.5
        for term in T.IDENTITY_TERMS:
            assert abs(m.score(f"{base} {term}.") - plain) < 0.05
            assert m.score(f"{base} nastyword vileword grimstema grimstemb {term}") >= 0.5
    held = [(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((m.score(t) >= 0.5) == bool(y) for t, y in held) / len(held) > 0.97


def test_counterfactuals_are_made_on_the_text():
    assert [*T.counterfactuals("All Women and MEN.")][2] == "all woman and woman."
    made = [*T.counterfactuals("plain words here")]
    assert len(made) == len(T.IDENTITY_TERMS) and all(t in T.words_of(x) and T.words_of(x) >= {"plain", "words", "here"} for t, x in zip(T.IDENTITY_TERMS, made))
    assert "".join(next(T.counterfactuals("?"))).split() == [T.IDENTITY_TERMS[0], "?"]
    assert not any(f.startswith(("musl*", "wome*", "immig*")) for f in T.features_of("muslims women immigrants muslimoid womenlike immigratory"))


def test_labels_of_one_class_and_order(spark, docs):
    assert 0 < T.learn(docs([(1, "a")]), spark.createDataFrame([], "doc_id long, toxic int"), Scratch(spark, "test")).score("x") < 0.5
    assert T.learn(docs([(i, "a") for i in range(400)]), spark.createDataFrame([(i, 1) for i in range(400)], "doc_id long, toxic int"), Scratch(spark, "test")).score("x") > 0.5


def test_learning_never_sees_held_out_labels(spark, docs, model):
    rows, labels, m = model
    from pyspark.sql import functions as F

    flipped = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = T.learn(docs([(i, t) for i, t, _ in rows]), flipped, Scratch(spark, "test"))
    assert again.weights == m.weights and again.bias == m.bias


def test_query(spark, docs, odd, tmp_path):
    rows = made(200)
    docs([(i + 1000, t) for i, t, _ in rows] + odd).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i + 1000, 1, t) for i, _, t in rows], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = toxicity_query.op6_toxicity(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) + len(odd)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    docs([]).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "none" / "labels.parquet"))
    assert toxicity_query.op6_toxicity(spark, str(tmp_path / "none")).count() == 0


def test_copies_share_a_vote():
    s = [T._sketch(T.words_of(" ".join(f"w{a}{k}" for k in "abcdefghijklmnopqrstuvwxyz"))) for a in "xyz"]
    assert T._votes([s[0], s[1], s[0], s[0]]).tolist() == pytest.approx([1 / 3, 1, 1 / 3, 1 / 3])
