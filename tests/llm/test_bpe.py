import hashlib
import random
import unicodedata

import public_tokenizers as P
import pytest
import regex
from tokenizers import Tokenizer

from millrace.llm import bpe, bpe_query

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def codec():
    return bpe.BpeCodec(bpe.read_spec(PATH))


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def same(codec, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = codec.encode(text)
    assert got.ids == want, text[:80]
    assert len(got) == len(want)
    assert got.ids_text == " ".join(map(str, want))
    assert got.decoded == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["", " ", "hello World's  end", "a<|endoftext|>b <|startoftext|>", "ΑΣ Σ ς", "aaa aaaa " * 5, "İI ﬁ é \x85 x\x1cy", "12345 3.14!!! ???", "日本語 🙂👍🏽  x　y", "a" * 5000, "ab" * 3000, "\x00\x01"])
def test_like_the_library(codec, library, text):
    same(codec, library, text)


def test_random_words_like_the_library(codec, library):
    r = random.Random(1)
    for _ in range(600):
        letters = r.choice(["ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "thern", "!?.#$", "äößéèñó日本🙂 "])
        same(codec, library, "".join(r.choices(letters, k=r.randint(1, 60))))


def test_pairs_of_tokens_like_the_library(codec, library):
    r = random.Random(2)
    plain = sorted(t for t in library.get_vocab() if t.isascii() and t.isalpha() and t.islower() and len(t) <= 6)
    for _ in range(400):
        word = r.choice(plain) + r.choice(plain)
        assert codec._word(word) == library.encode(word, add_special_tokens=False).ids


def test_letters_that_unicode_added_lately(codec, library):
    late = [c for c in map(chr, range(0xA0, 0x40000)) if unicodedata.category(c) == "Cn" and (regex.match(r"[\p{L}\p{N}]", c) or bpe._like(c) != "\ue000")]
    assert len(late) > 4_000
    texts = [x for c in [*late, *map(chr, bpe._CAPITALS)] for x in (f"a{c}b1", f"{c}'s é{c}{c}!{c}")]
    for x, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert codec.encode(x).ids == want.ids, x


def test_rejects_other_tokenizers():
    with pytest.raises(ValueError):
        bpe.BpeCodec(bpe.read_spec(P.path("byte_bpe_50k.json")))


def test_documents(spark, docs, odd, library):
    out = bpe.encode_documents(docs(odd), bpe.read_spec(PATH)).collect()
    assert len(out) == len(odd)
    for row in out:
        want = library.encode(row.text or "", add_special_tokens=False).ids
        assert row.token_ids == want and row.n_tokens == len(want)
    assert bpe.encode_documents(docs(odd).limit(0), bpe.read_spec(PATH)).count() == 0


def test_query(spark, tmp_path, docs, odd, library):
    docs(odd).write.parquet(str(tmp_path / "documents.parquet"))
    out = bpe_query.op1_bpe_codec(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    rows = {}
    for i, t in odd:
        ids = library.encode(t or "", add_special_tokens=False).ids
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        rows[i, len(ids), *digests] = rows.get((i, len(ids), *digests), 0) + 1
    got = {}
    for r in out.collect():
        got[tuple(r)] = got.get(tuple(r), 0) + 1
    assert got == rows and {r[1] for r in rows if r[0] in (1, 2, 3)} == {0}


def test_whole_texts_of_the_small_table(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in bpe_query.op1_bpe_codec(spark, "/root/testdata/sf0.001").collect():
        ids = library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
