"""Streams: texts met before are not analysed again; polarity and centres equal the batch operators'."""

import numpy as np
from pyspark.sql import functions as F

from textlab.operators import classify, cluster, vectors, vocab
from textlab.session import scratch_path
from textlab.sources import synthetic
from textlab.streaming import online

SCHEMA = "ord bigint, text string"


class _Stream:
    """A source folder that grows, and the texts that the analysis was asked for, run by run."""

    def __init__(self, spark, keep=None):
        self.spark, self.keep, self.asked = spark, keep, []
        self.source, self.out, self.store, self.ckpt = (scratch_path(spark, n) for n in ("src", "out", "store", "ckpt"))

    def analyse(self, new):
        self.asked[-1] += sorted(r["text"] for r in new.collect())
        return new.select("ord", F.upper("text").alias("loud"), F.length("text").alias("digits"))

    def run(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.source)
        self.asked.append([])
        online.run_reusing(self.spark, self.source, SCHEMA, "ord", "text", self.analyse, self.out, self.store,
                           self.ckpt, self.keep)
        return self.asked[-1]

    def got(self):
        return sorted(((r["ord"], r["loud"], r["digits"]) for r in online.read_online(self.spark, self.out).collect()),
                      key=str)


def test_texts_met_before_are_not_analysed_again(spark):
    s = _Stream(spark)
    assert s.run([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")]) == ["", "a", "b"]
    assert s.run([(6, "b"), (7, "a"), (7, "a"), (8, None)]) == []
    assert s.run([(9, "c"), (10, "b")]) == ["c"]
    assert s.got() == sorted([(1, "A", 1), (2, "B", 1), (3, "A", 1), (4, None, None), (5, "", 0), (6, "B", 1),
                              (7, "A", 1), (7, "A", 1), (8, None, None), (9, "C", 1), (10, "B", 1)], key=str)
    assert spark.read.parquet(s.store).count() == 4


def test_results_expire(spark):
    s = _Stream(spark, keep=1)
    assert s.run([(1, "a")]) == ["a"] and s.run([(2, "a"), (3, "b")]) == ["b"]
    assert s.run([(4, "a")]) == ["a"]         # made in the first micro-batch, which serves one more
    assert [r[1] for r in s.got()] == ["A", "A", "B", "A"] and online._written(spark, s.store) == [2]


def test_a_stream_of_nulls(spark):
    s = _Stream(spark)
    assert s.run([(1, None), (2, None)]) == [] and s.got() == [(1, None, None), (2, None, None)]


def test_a_text_that_fills_the_batch(spark, monkeypatch):
    from textlab.operators import common
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    s = _Stream(spark)
    assert s.run([(i, "same" if i % 3 else f"t{i}") for i in range(300)]) == sorted({f"t{i}" for i in range(0, 300, 3)} | {"same"})
    assert [g[1] for g in s.got() if g[0] % 3] == ["SAME"] * 200 and len(s.got()) == 300


def test_polarity_and_centre_of_arriving_texts(spark):
    words = {0: ["bad", "poor", "awful"], 1: ["good", "fine", "great"]}
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(words[i % 2], 4))) for i in range(80)] + [(80, None), (81, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    v = vocab.build_vocab(vocab.tokens(docs))
    wv = synthetic.derived_word_vectors(v.where(F.col("id") >= 2), 8)
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "ord bigint, label int")
    pol = classify.train(classify.hashed_features(docs), labels)
    batch = vectors.sentence_vectors(docs, v, wv, 8)
    centres = batch.where(F.col("ord") < 3).select(F.col("ord").cast("int").alias("cluster"), F.col("vec").alias("centre"))
    source = scratch_path(spark, "texts")
    docs.repartition(3, "ord").write.parquet(source)
    out = online.run_online(spark, source, SCHEMA, "ord", "text", v, wv, 8, max_files=1, polarity=pol, centres=centres)
    got = {r["ord"]: r for r in online.read_online(spark, out).collect()}
    assert len(got) == 82
    assert all(got[i]["polarity"] == ("positive" if i % 2 else "negative") for i in range(80))
    scored = {r["ord"]: r["p_positive"] for r in classify.score(pol, classify.hashed_features(docs)).collect()}
    near = {r["id"]: r["center"] for r in
            cluster.nearest_centre(batch.select(F.col("ord").alias("id"), "vec"), centres).collect()}
    for i, r in got.items():
        assert abs(r["p_positive"] - scored[i]) < 1e-12 and r["center"] == near[i]


def test_the_documents_table_may_be_a_file_or_a_folder(spark, tmp_path):
    from textlab.plans import catalog
    rows = [(i, f"w{i % 3} w{i % 5}", "en", "web", 5) for i in range(12)] + [(12, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(3, "doc_id").write.parquet(str(tmp_path / "folder" / "documents.parquet"))
    docs.coalesce(1).write.parquet(str(tmp_path / "part"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "part").glob("part-*.parquet")).rename(tmp_path / "file" / "documents.parquet")
    got = [sorted(map(tuple, catalog.REGISTRY[q](spark, str(tmp_path / kind)).collect()), key=str)
           for q in ("online_vectors", "online_centres") for kind in ("folder", "file")]
    assert got[0] == got[1] and len(got[0]) == 13 * catalog.WV_DIM
    assert got[2] == got[3] and len(got[2]) == 13
