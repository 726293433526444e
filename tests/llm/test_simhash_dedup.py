import itertools
import random
import re

import xxhash

from millrace.llm import simhash_dedup as D
from millrace.llm import simhash_dedup_query
from millrace.llm.common import Scratch
from millrace.llm.components import connected_components


def brute_fingerprint(t):
    s = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", s)
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(pairs, radius):
    """pairs: (doc_id, fp); smallest doc_id within reach."""
    fps = sorted({f for _, f in pairs})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= radius:
            parent[find(a)] = find(b)
    least = {}
    for i, f in pairs:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return {(i, f): least.get(find(f)) for i, f in pairs}


def near_texts():
    r = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [" ".join(r.choices(words, k=r.choice([5, 40, 300]))) for _ in range(25)]
    out = []
    for i, t in enumerate(base):
        out.append((100 - i, t))
        if i % 3 == 0:
            w = t.split(" ")
            w[len(w) // 2] = "changed"
            out += [(200 + i, " ".join(w)), (300 + i, t.upper())]
    return out


def test_fingerprint_like_brute_force(odd):
    for _, t in [*near_texts(), *odd[:-1], (0, "A b\x0bC\x1cd e")]:
        assert D.text_fingerprint(t) == brute_fingerprint(t)
    assert D.text_fingerprint("x y z " * 70_000) == D.text_fingerprint("x y z " * 70_000)


def test_fingerprint_of_long_texts_is_over_the_whole(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(900))
    want = D.text_fingerprint(text)
    monkeypatch.setattr(D, "_BLOCK", 64)
    assert D.text_fingerprint(text) == want == brute_fingerprint(text)


def test_near_duplicates_like_brute_force(spark, docs, odd):
    rows = near_texts() + odd
    got = D.near_duplicates(docs(rows)).collect()
    want = brute_components([(i, brute_fingerprint(t)) for i, t in rows], 2)
    assert len(got) == len(rows)
    assert {((r.doc_id, r.fp % 2**64), r.component_id) for r in got} == set(want.items())


def test_chains_of_fingerprints_are_one_component(spark):
    scratch = Scratch(spark, "test")
    r = random.Random(1)
    fps, f = [], r.getrandbits(63)
    for _ in range(40):
        fps.append(f)
        for k in r.sample(range(63), 2):
            f ^= 1 << k
    fps += [r.getrandbits(63) for _ in range(50)]
    df = spark.createDataFrame([(x,) for x in sorted(set(fps))], "fp long")
    found = {(x.node, x.root) for x in connected_components(D.links(df), "a", "b", scratch).collect()}
    want = brute_components([(x, x) for x in fps], 2)
    assert {(n, root) for n, root in found} == {(i, c) for (i, _), c in want.items() if sum(v == c for v in want.values()) > 1}


def test_components_of_odd_edges(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 2), (None, 3), (4, 5), (5, 6), (9, 4), (7, 7)], "a long, b long")
    out = {(r.node, r.root) for r in connected_components(edges, "a", "b", Scratch(spark, "test")).collect()}
    assert out == {(1, 1), (2, 1), (4, 4), (5, 4), (6, 4), (9, 4)}
    assert connected_components(edges.limit(0), "a", "b", Scratch(spark, "test")).count() == 0


def test_keep_one(spark, docs, odd):
    df = docs([(1, "a b c d"), (2, "A B c d"), (3, "other words in here"), *odd])
    out = D.keep_one(df, D.near_duplicates(df))
    ids = [r.doc_id for r in out.collect()]
    assert 2 not in ids and 3 in ids and ids.count(None) == 1 and ids.count(1) == 1
    assert out.columns == df.columns


def test_query(spark, tmp_path, docs):
    docs([(i, "") for i in range(3)]).write.parquet(str(tmp_path / "documents.parquet"))
    out = simhash_dedup_query.op8_simhash_near_dedup(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in out} == {(i, "0" * 16, 0) for i in range(3)}
    docs([]).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert simhash_dedup_query.op8_simhash_near_dedup(spark, str(tmp_path / "none")).count() == 0
