import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import line_dedup as L
from millrace.llm import line_dedup_query


def shingles(line):
    return {line[i : i + L.SHINGLE] for i in range(max(1, len(line) - L.SHINGLE + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute(docs):
    """Text of each document after dedup, by comparing all lines with each other."""
    where = {}
    for d, t in docs:
        for n, line in enumerate((t or "").split("\n")):
            if len(x := L.normalized(line)) >= L.MIN_CHARS:
                where.setdefault(x, []).append((-(1 << 63) if d is None else d, n))
    lines = list(where)
    sets = [shingles(x) for x in lines]
    parent = list(range(len(lines)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(lines)), 2):
        if jaccard(sets[i], sets[j]) >= L.SIMILARITY:
            parent[find(i)] = find(j)
    first = {}
    for i, x in enumerate(lines):
        first[find(i)] = min([*where[x], first.get(find(i), (1 << 63, 0))])
    at = {x: find(i) for i, x in enumerate(lines)}
    out = {}
    for d, t in docs:
        if t is None:
            out[d] = None
            continue
        rest = [line for n, line in enumerate(t.split("\n")) if len(x := L.normalized(line)) < L.MIN_CHARS or first[at[x]] == ((-(1 << 63) if d is None else d), n)]
        out[d] = "\n".join(rest)
    return out


def corpus(seed=5):
    r = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdfk" for b in "aeou" for c in ("n", "rt", "lm")]
    pool = [" ".join(r.choices(words, k=r.randint(3, 30))) for _ in range(60)]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(r.randint(1, 8)):
            line = r.choice(pool)
            if r.random() < 0.4:
                w = line.split(" ")
                w[r.randrange(len(w))] = r.choice(words)
                line = " ".join(w)
            lines.append(r.choice([line, line.upper(), f"  {line} ", "short", ""]))
        docs.append((d, "\n".join(lines)))
    return docs


def test_like_brute_force(spark, docs):
    rows = [*corpus(), (1000, None), (1001, ""), (None, "a line without a document id, long enough\n\nx")]
    out = L.deduplicate_lines(docs(rows))
    assert out.columns[:-1] == docs(rows).columns
    assert {r.doc_id: r.text for r in out.collect()} == brute(rows)


def test_large_buckets_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr(L, "BLOCK", 4)
    base = " ".join(f"word{i}" for i in range(40))
    rows = [(i, base.replace(f"word{i}", f"other{i}")) for i in range(30)] + [(100 + i, " ".join(f"x{i}y{k}" for k in range(12))) for i in range(5)]
    assert {r.doc_id: r.text for r in L.deduplicate_lines(docs(rows)).collect()} == brute(rows)


@pytest.mark.parametrize("sample", [1, 2])
def test_hot_bands_give_the_same_result(spark, docs, monkeypatch, sample):
    for name, value in (("HOT_SAMPLE", sample), ("HOT_LEAST", 1), ("HOT_SHARE", 1 << 30), ("BLOCK", 8)):
        monkeypatch.setattr(L, name, value)
    base = " ".join(f"word{i}" for i in range(30))
    rows = [*corpus(11), *((200 + i, base.replace(f"word{i % 30}", f"other{i}")) for i in range(40))]
    lines = L._lines(docs(rows).select(F.col("doc_id").alias("row_key"), "doc_id", "text"), 1)
    assert L._hot_bands(lines)
    assert {r.doc_id: r.text for r in L.deduplicate_lines(docs(rows)).collect()} == brute(rows)


def test_recall_of_banding():
    r = random.Random(7)
    met = total = 0
    for _ in range(400):
        a = "".join(r.choices("abcdefghij ", k=r.randint(60, 300)))
        k = r.randrange(1, max(2, len(a) // 45))
        b = list(a)
        for _ in range(k):
            b[r.randrange(len(b))] = "z"
        b = "".join(b)
        if jaccard(shingles(a), shingles(b)) >= L.SIMILARITY:
            x, y = L.band_hashes([a, b])
            met += bool((x == y).any())
            total += 1
    assert total > 100 and met / total > 0.99


def test_sets_and_bitmaps_of_any_lines():
    r = random.Random(3)
    lines = ["".join(r.choices("abc é😀", k=r.choice([1, 7, 8, 9, 40, 3000]))) for _ in range(60)]
    lines += [x[: len(x) // 2] + "z" + x[len(x) // 2 :] for x in lines] + ["a" * 500, "a" * 501]
    sets, bits = L.shingle_sets(lines), L.bitmaps(lines)
    assert [len(x) for x in sets] == [len(shingles(x)) for x in lines]
    count = 0
    for i, j in itertools.combinations(range(len(lines)), 2):
        true = jaccard(shingles(lines[i]), shingles(lines[j])) >= L.SIMILARITY
        assert L.similar(sets[i], sets[j], L.SIMILARITY) == true
        m, n = (max(1, len(lines[k]) - L.SHINGLE + 1) for k in (i, j))
        assert not true or L._may_be_similar(bits[i], bits[j], m, n, L.SIMILARITY)
        count += true
    assert count > 20


def test_signatures_do_not_depend_on_the_batch():
    lines = [t for _, d in corpus() for t in d.split("\n") if len(t) >= L.MIN_CHARS]
    together = L.band_hashes(lines)
    assert all(np.array_equal(together[i], L.band_hashes([x])[0]) for i, x in enumerate(lines[:40]))


def test_repeated_rows_and_empty_tables(spark, docs, tmp_path):
    line = "this very line stands in both of the rows"
    out = L.deduplicate_lines(docs([(5, line), (5, line), (6, line + "\nand a second line that only stands here")])).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(5, line), (5, line), (6, "and a second line that only stands here")]
    assert L.deduplicate_lines(docs([])).count() == 0
    docs([(1, "one " * 50_000), (2, "one " * 50_000)]).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in line_dedup_query.op10_line_dedup(spark, str(tmp_path)).collect()}
    assert got[1].n_chars == 200_000 and got[2].text == "" and got[2].removed_lines == 1


def test_short_lines_are_compared_too(spark, docs):
    rows = [(1, "All rights reserved.\nof.\n\nof.\nx"), (2, "a text of its own\n  ALL rights  reserved.\n\nX\nno. 12345678901"), (3, "No. 123456789012\nall rights waived.")]
    out = {r.doc_id: r.text for r in L.deduplicate_lines(docs(rows)).collect()}
    assert out == brute(rows) == {1: "All rights reserved.\nof.\n\nx", 2: "a text of its own\n\nno. 12345678901", 3: "all rights waived."}
