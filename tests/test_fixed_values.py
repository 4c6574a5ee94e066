"""Values of the seeded fill (E3), the 2-D projection (G1) and the polarity model (A1), against numpy."""

import math
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textlab.operators import classify, cluster, vectors
from textlab.plans.tables import documents, embeddings, table

SMOKE = "/root/testdata/sf0.001"


def _noise(word, dim):
    def unif(j, salt):
        h = xxhash.xxh64_intdigest(word.encode(), seed=42)
        for x in (j, salt):
            h = xxhash.xxh64_intdigest(struct.pack("<i", x), seed=h)
        h -= (h >> 63) << 64
        return (h % 2147483647 + 1) / 2147483648
    return [math.sqrt(-2 * math.log(unif(j, 1))) * math.cos(2 * math.pi * unif(j, 2)) * 0.01 for j in range(dim)]


def test_seeded_fill(spark):
    words = ["known", "missing", "好", ""] + [f"w{i}" for i in range(300)]
    vocab = spark.createDataFrame([(w, i + 2) for i, w in enumerate(words)], "word string, id bigint")
    wv = spark.createDataFrame([("known", [1.0, 2.0, 3.0])], "word string, vec array<double>")
    got = {r["id"]: list(r["vec"]) for r in vectors.vector_table(vocab, wv, 3, fill="seeded").collect()}
    assert got[0] == [0.0] * 3 and got[1] == got[2] == [1.0, 2.0, 3.0]   # [UNK]: mean of the vectors found
    for i, w in enumerate(words[1:], 3):
        assert got[i] == pytest.approx(_noise(w, 3), abs=1e-12)
    drawn = np.array([got[i] for i in range(3, len(words) + 2)])
    assert abs(drawn.mean()) < 0.002 and abs(drawn.std() - 0.01) < 0.001
    zero = {r["id"]: list(r["vec"]) for r in vectors.vector_table(vocab, wv, 3).collect()}
    assert zero[3] == [0.0] * 3


def test_projection_is_on_the_two_first_components(spark):
    points = embeddings(spark, SMOKE)
    rows = points.orderBy("id").collect()
    x = np.array([r["vec"] for r in rows], dtype=float)
    _, vec = np.linalg.eigh(np.cov(x.T))
    want = x @ vec[:, ::-1][:, :2]
    got = {r["id"]: r for r in cluster.projection_2d(points).collect()}
    xy = np.array([[got[r["id"]]["x"], got[r["id"]]["y"]] for r in rows])
    want *= np.sign((want * xy).sum(axis=0))
    assert np.abs(want - xy).max() < 1e-6
    ranks = {c: i % 10 for i, c in enumerate(sorted({r["cluster"] for r in rows} - {-1}))}
    assert all(got[r["id"]]["color_idx"] == ranks.get(r["cluster"]) for r in rows)


def _labelled(spark, three):
    label = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2) if three else F.col("quality")
    labels = table(spark, SMOKE, "labels").select(F.col("doc_id").alias("ord"), label.alias("label"))
    return classify.hashed_features(documents(spark, SMOKE)), labels


def _auc(scores, labels):
    pos, neg = scores[labels == 1], scores[labels == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("three", [False, True])
def test_polarity_scores_are_those_of_the_least_loss(spark, three):
    feats, labels = _labelled(spark, three)
    pol = classify.train(feats, labels, max_iter=300)
    x_of = {r["ord"]: r["features"].toArray() for r in feats.collect()}
    got = {r["ord"]: r for r in classify.score(pol, feats).collect()}
    assert set(got) == set(x_of)
    rows = labels.select("ord", "label", classify.held_out().alias("out")).where("label IS NOT NULL").collect()
    fit = [r for r in rows if not r["out"] and r["ord"] in x_of]
    x = np.array([x_of[r["ord"]] for r in fit])
    y = np.array([r["label"] for r in fit])

    # softmax over one row of weights a class (two classes: the first row is zero)
    w = pol.model.coefficientMatrix.toArray()
    b = pol.model.interceptVector.toArray()
    if not three:
        w, b = np.vstack([0 * w, w]), np.concatenate([[0.0], b])

    def probability(rows_):
        z = rows_ @ w.T + b
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    p = probability(x)
    wrong = p - np.eye(len(b))[y]
    slope = wrong.T @ x / len(y) + 0.01 * w * x.std(axis=0, ddof=1) ** 2     # penalty on standardised weights
    first = 0 if three else 1
    assert np.abs(slope[first:]).max() < 1e-4 and np.abs(wrong.mean(axis=0)).max() < 1e-3

    ids = sorted(got)
    every = probability(np.array([x_of[i] for i in ids]))
    assert np.abs(every[:, -1] - [got[i]["p_positive"] for i in ids]).max() < 1e-9
    assert [got[i]["prediction"] for i in ids] == list(every.argmax(axis=1))
    names = np.array(["negative", "neutral", "positive"])
    if three:
        assert [got[i]["polarity"] for i in ids] == list(names[every.argmax(axis=1)])
    else:
        last = every[:, 1]
        assert [got[i]["polarity"] for i in ids] == list(names[np.where(last >= 0.6, 2, np.where(last <= 0.4, 0, 1))])
        held = [r for r in rows if r["out"]]
        assert pol.auc == pytest.approx(_auc(np.array([got[r["ord"]]["p_positive"] for r in held]),
                                             np.array([r["label"] for r in held])), abs=1e-9)

    counts = {(r["label"], r["prediction"], r["held_out"]): r["n"]
              for r in classify.confusion(classify.score(pol, feats), labels).collect()}
    want = {}
    for r in rows:
        key = (r["label"], got[r["ord"]]["prediction"], r["out"])
        want[key] = want.get(key, 0) + 1
    assert {k: n for k, n in counts.items() if k[0] is not None} == want
