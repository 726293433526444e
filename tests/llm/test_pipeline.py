import hashlib

import corpus_pipeline as C
import public_tokenizers
from pyspark.sql import functions as F

from millrace.llm import bpe


def test_stages_on_the_small_table(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    originals = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, docs, d)
        if k < len(C.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if name == "SimHash near-dedup":
            assert docs.select("doc_id").distinct().count() == docs.count()
    assert counts[0] > counts[1] >= counts[2] >= counts[3]
    assert {"doc_id", "token_ids", "n_tokens"} <= set(docs.columns)
    assert docs.where(F.size("token_ids") != F.col("n_tokens")).count() == 0
    assert {r.doc_id for r in docs.collect()} <= set(originals)


def test_clean_documents_stay_through_the_filtering_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    good = spark.read.parquet(f"{d}/labels.parquet").where("quality = 1").join(docs, "doc_id").where(F.size(F.split("text", " ")) > 12)
    kept = C.STAGES[0][1](spark, docs, d).select("doc_id")
    assert good.join(kept, "doc_id", "left_anti").count() <= 0.02 * good.count()


def test_empty_table(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    for t in ("documents", "labels"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert C.run(spark, str(tmp_path)).count() == 0


def test_the_last_stage_decodes(spark, docs):
    codec = bpe.codec(bpe.read_spec(public_tokenizers.path("word_bpe_49k.json")))
    texts = {1: "Some words, and SOME numbers: 12345.", 2: "", 3: None, 4: "été 日本 🙂"}
    got = C.encode(spark, docs([*texts.items()]), "").collect()
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        assert list(r.token_ids) == codec.encode(texts[r.doc_id]).ids
        assert r.decoded_sha256 == hashlib.sha256(codec.decode(r.token_ids).encode("utf-8")).hexdigest()
