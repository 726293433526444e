import hashlib
import random

from millrace.llm import fingerprints as P
from millrace.llm import fingerprints_query
from millrace.llm.common import Scratch


def texts(n=60):
    r = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    out = [(300 + i * 3, " ".join(r.choices(words, k=r.randint(1, 80)))) for i in range(n)]
    return out + [(1000, out[5][1]), (1100, out[5][1]), (1200, "é" * 31)]


def in_order(rows):
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""), reverse=True)


def edited(rows):
    o = in_order(rows)
    out = []
    for k, (i, t) in enumerate(o):
        t, u = t or "", o[(k + 1) % len(o)][1] or ""
        h = len(t) // 2
        out.append((str(i), len(t), hashlib.sha256((t[: len(t) - h] + u[:h]).encode()).hexdigest()))
    return sorted(out)


def test_query_like_brute_force(spark, docs, odd, tmp_path):
    rows = [*texts(), *odd]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = fingerprints_query.op4_fingerprints(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == edited(rows)
    fp = {r.doc_id: r.fingerprint for r in got if r.doc_id not in (5, None)}
    assert fp[1000] == fp[1100] == fp[315] and fp[1] == fp[2] == fp[3] == "0" * 32
    o = [i for i, _ in in_order(rows)]
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        nxt = o[(o.index(r.doc_id) + 1) % len(o)] if r.doc_id not in (5, None) else None
        if nxt in fp:
            assert abs(r.near_next - (1 - (int(r.fingerprint, 16) ^ int(fp[nxt], 16)).bit_count() / 128)) < 1e-12
        if r.doc_id is not None and r.doc_id % 100 == 0:
            assert r.n_near == sum((int(r.fingerprint, 16) ^ int(x.fingerprint, 16)).bit_count() <= 3 for x in got)
        else:
            assert r.n_near is None


def test_votes_like_brute_force(spark):
    from pyspark.sql import functions as F

    text = "a b c a b d e f a b"
    df = spark.createDataFrame([(text,)], "t string")
    hashes = df.select(F.explode(P.terms(F.col("t"))).alias("term"))
    words = [[x % 2**64 for x in r] for r in hashes.select(*P._hash_words(F.col("term"))).collect()]
    assert len(words) == 9
    row = hashes.agg(F.count("term").alias("total"), *P.vote_sums("term")).select(*P.vote_bits(F.col("total"))).first()
    for k in range(2):
        assert row[k] % 2**64 == sum(1 << i for i in range(64) if 2 * sum(w[k] >> i & 1 for w in words) > len(words))


def test_block_tables_find_all_within_the_radius(spark):
    r = random.Random(6)
    base = [r.getrandbits(128) for _ in range(20)]
    prints = list(base)
    for b in base:
        for k in (1, 2, 3, 4, 5):
            x = b
            for bit in r.sample(range(128), k):
                x ^= 1 << bit
            prints.append(x)
    signed = lambda v: v - 2**64 if v >> 63 else v
    df = spark.createDataFrame([(signed(p >> 64), signed(p % 2**64)) for p in prints], "w0 long, w1 long")
    got = {(x.q0 % 2**64 << 64 | x.q1 % 2**64, x.w0 % 2**64 << 64 | x.w1 % 2**64): x.apart for x in P.within_radius(df.limit(40), df).collect()}
    want = {(a, b): (a ^ b).bit_count() for a in prints[:40] for b in prints if (a ^ b).bit_count() <= 3}
    assert got == want


def test_one_row_and_none(spark, docs):
    one = P.fingerprint_documents(docs([(7, "a b c d")])).collect()
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in one] == [(7, 7, hashlib.sha256(b"a b a b"[:4] + b"a b").hexdigest())]
    assert P.fingerprints_with_neighbours(docs([]), Scratch(spark, "test")).count() == 0
    many = P.next_in_order(docs([(i, str(i)) for i in range(50)]), ranges=7).where("not extra").collect()
    assert {r.doc_id: r.next_text for r in many} == {i: str((i - 1) % 50) for i in range(50)}


def test_near_copies_are_counted(spark, docs, tmp_path):
    r = random.Random(8)
    base = [f"w{r.randrange(3000)}" for _ in range(300)]
    rows = [(100, " ".join(base)), (1, " ".join(base))]
    for k in range(2, 12):
        w = list(base)
        for i in r.sample(range(300), k // 2):
            w[i] = f"x{k}"
        rows.append((k, " ".join(w)))
    rows += [(20 + i, " ".join(f"w{r.randrange(3000)}" for _ in range(300))) for i in range(30)]
    docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x for x in fingerprints_query.op4_fingerprints(spark, str(tmp_path)).collect()}
    apart = [(int(got[100].fingerprint, 16) ^ int(x.fingerprint, 16)).bit_count() for x in got.values()]
    assert got[100].n_near == sum(a <= 3 for a in apart) and got[100].n_near_copies == sum(a <= P.COPY_RADIUS for a in apart) > 6
    assert all(x.n_near_copies is None for i, x in got.items() if i != 100)


def test_block_tables_with_flips_find_all_within_the_radius(spark):
    r = random.Random(9)
    base = [r.getrandbits(128) for _ in range(8)]
    prints = base + [b ^ sum(1 << i for i in r.sample(range(128), k)) for b in base for k in range(1, 26)]
    signed = lambda v: v - 2**64 if v >> 63 else v
    df = spark.createDataFrame([(signed(p >> 64), signed(p % 2**64)) for p in prints], "w0 long, w1 long")
    got = [(x.q0 % 2**64 << 64 | x.q1 % 2**64, x.w0 % 2**64 << 64 | x.w1 % 2**64, x.apart) for x in P.within_radius(df.limit(8), df, P.COPY_RADIUS, P.FLIPS).collect()]
    assert sorted(got) == sorted((a, b, (a ^ b).bit_count()) for a in base for b in prints if (a ^ b).bit_count() <= P.COPY_RADIUS)
