import corpus_pipeline
import numpy as np
import public_tokenizers
from helpers import SMALL, empty_docs, odd_docs, rows_of
from pyspark.sql import functions as F

from test_simhash import slow_classes, slow_fingerprint
from test_spans import brute
from textlab.llm import bpe, mixing


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    (_, good), (_, distinct), (_, spans), (_, mixed), (_, encoded) = corpus_pipeline.STAGES
    labels = dict(rows_of("labels", "doc_id, quality"))

    one = good(spark, docs, SMALL).collect()
    kept = {r["doc_id"] for r in one}
    assert all(i in kept for i, q in labels.items() if q == 1)
    assert np.mean([i in kept for i, q in labels.items() if q == 0]) < 0.5

    frame = spark.createDataFrame(one, docs.schema)
    two = distinct(spark, frame, SMALL).collect()
    root = slow_classes(np.array([slow_fingerprint(r["text"]) for r in one], np.uint64))
    low = {}
    for r, k in zip(one, root, strict=True):
        low[k] = min(low.get(k, r["doc_id"]), r["doc_id"])
    assert sorted(r["doc_id"] for r in two) == sorted(low.values())

    three = spans(spark, spark.createDataFrame(two, docs.schema), SMALL).collect()
    assert {r["doc_id"]: r["text"] for r in three} == brute([(r["doc_id"], r["text"]) for r in two])
    assert all(r["n_chars"] == len(r["text"]) for r in three)

    frame = spark.createDataFrame(three, docs.schema)
    four = mixed(spark, frame, SMALL)
    assert four.columns == docs.columns
    want = {r["doc_id"]: r["copies"] for r in mixing.copies(frame).collect()}
    ids = [r["doc_id"] for r in four.collect()]
    assert {i: ids.count(i) for i in want} == want

    own = bpe.load(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    five = encoded(spark, four, SMALL).collect()
    assert len(five) == len(ids)
    assert all(own.decode(np.frombuffer(r["ids"], "<u4")) == r["text"].encode() for r in five)


def test_odd_and_empty_tables(spark, tmp_path):
    for name, docs in (("odd", odd_docs(spark)), ("empty", empty_docs(spark))):
        sf = f"{tmp_path}/{name}"
        docs.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(i, int(i != 9)) for i in range(1, 10)], "doc_id long, quality int") \
            .limit(9 if name == "odd" else 0).write.parquet(f"{sf}/labels.parquet")
        out = corpus_pipeline.run(spark, sf)
        assert [c for c in docs.columns if c != "ids"] == [c for c in out.columns if c not in ("ids", "n_tokens")]
        assert (out.count() > 0) == (name == "odd")


def test_text_of_the_last_stage_is_decoded_from_its_ids(spark, monkeypatch):
    docs = odd_docs(spark)
    out = corpus_pipeline.encoded(spark, docs, SMALL)
    assert "__text" not in out.columns
    key = lambda rows: sorted((r["doc_id"] or 0, r["text"] is None, r["text"] or "") for r in rows)
    assert key(out.collect()) == key(docs.collect())
    # with other decoded bytes the text is another one
    encode = bpe.encode
    monkeypatch.setattr(bpe, "encode", lambda *a, **b: encode(*a, **b).withColumn("__text", F.lit(b"other")))
    assert {r["text"] for r in corpus_pipeline.encoded(spark, docs, SMALL).collect()} == {None, "other"}
