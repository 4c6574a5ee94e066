"""Mini-batch k-means: against Lloyd's, a slow copy of the update, other layouts, and as a stream."""

import dataclasses

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.config import DEFAULTS
from textlab.operators import cluster, minibatch
from textlab.plans import pipeline
from textlab.session import scratch_path
from textlab.streaming import online

SCHEMA = "id bigint, vec array<double>"


def _frame(spark, x, ids=None):
    return spark.createDataFrame([(int(ids[i]) if ids is not None else i, [float(v) for v in r])
                                  for i, r in enumerate(x)], SCHEMA)


def _planted(n=1500, d=6, k=5, seed=1):
    rng = np.random.default_rng(seed)
    own = rng.integers(0, k, n)
    return rng.normal(size=(k, d))[own] * 6 + rng.normal(size=(n, d)) * 0.5, own


def _slow(centres, seen, batch):
    """The update row by row: all rows of a batch see the centres as they were before it."""
    own = [min(range(len(centres)), key=lambda j: (float(((x - centres[j]) ** 2).sum()), j)) for x in batch]
    out, n = [c.copy() for c in centres], list(seen)
    for x, j in zip(batch, own):
        n[j] += 1
        out[j] = out[j] + (x - out[j]) / n[j]
    return np.array(out), np.array(n)


def test_finds_planted_clusters_at_lloyds_cost(spark):
    x, own = _planted()
    pts = _frame(spark, x).cache()
    res = minibatch.fit(pts, 5, batch=128)
    lloyd = cluster.kmeans(pts, 5)
    assert res.cost <= 1.02 * lloyd.cost
    found = {r["id"]: r["cluster"] for r in res.assignments.collect()}
    assert len({(own[i], c) for i, c in found.items()}) == 5
    at, d = minibatch.nearest(x, res.centres.values)
    assert [found[i] for i in range(len(x))] == at.tolist() and res.cost == pytest.approx(d.sum())


def test_cost_without_structure_is_lloyds_within_two_percent(spark):
    pts = _frame(spark, np.random.default_rng(4).normal(size=(2000, 16))).cache()
    assert minibatch.fit(pts).cost <= 1.02 * cluster.kmeans(pts).cost


def test_layout_and_session_do_not_change_the_centres(spark):
    x, _ = _planted(700)
    pts = _frame(spark, x)
    a = minibatch.fit(pts, 4, batch=64, steps=20)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        b = minibatch.fit(pts.orderBy(F.desc("id")).repartition(3), 4, batch=64, steps=20)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert np.array_equal(a.centres.values, b.centres.values)
    assert sorted(a.assignments.collect()) == sorted(b.assignments.collect())


def test_a_step_is_the_slow_update(spark):
    x, _ = _planted(300, d=3)
    now, slow = minibatch.Centres(x[:4].copy(), np.zeros(4)), (x[:4].copy(), np.zeros(4))
    for at in range(0, 300, 75):
        now = minibatch.learn(now, _frame(spark, x[at:at + 75]).repartition(5))
        slow = _slow(*slow, x[at:at + 75])
    assert np.allclose(now.values, slow[0]) and now.weights.tolist() == slow[1].tolist()
    assert now.weights.sum() == 300


def test_a_weight_is_that_many_rows(spark):
    x, _ = _planted(60, d=3)
    n = np.arange(60) % 4
    first = minibatch.Centres(x[:3].copy(), np.zeros(3))
    weighted = spark.createDataFrame([(i, [float(v) for v in r], int(n[i])) for i, r in enumerate(x)], SCHEMA + ", n int")
    a = minibatch.learn(first, weighted, "n")
    b = minibatch.learn(first, _frame(spark, np.repeat(x, n, axis=0)))
    assert np.allclose(a.values, b.values) and a.weights.tolist() == b.weights.tolist()


def test_bounded_rows_of_a_larger_table(spark):
    pts = spark.range(40_000).select("id", F.array((F.col("id") % 3).cast("double") * 9,
                                                   (F.col("id") % 101).cast("double") / 101).alias("vec"))
    res = minibatch.fit(pts, 3, batch=64, steps=10)
    assert 64 <= res.centres.weights.sum() < 1.3 * 640       # the start saw its batches only
    assert sorted(round(c[0], 6) for c in res.centres.values) == [0, 9, 18]
    assert {r["cluster"]: r["count"] for r in res.assignments.groupBy("cluster").count().collect()}.keys() == {0, 1, 2}
    assert res.assignments.count() == 40_000


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, [1.0, 2.0])], SCHEMA)
    assert minibatch.fit(empty) is None and minibatch.fit(one) is None and minibatch.start(empty) is None
    same = spark.createDataFrame([(1, [1.0, 2.0])] * 9 + [(2, None)], SCHEMA)     # repeated rows, a null, ties
    res = minibatch.fit(same)
    assert res.k == 5 and res.cost == 0 and {tuple(r) for r in res.assignments.collect()} == {(1, 0)}
    kept = minibatch.learn(res.centres, empty)
    assert np.array_equal(kept.values, res.centres.values)
    with pytest.raises(ValueError):
        minibatch.fit(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA))


def test_stream_moves_the_centres_once_a_batch(spark):
    x, _ = _planted(240, d=3)
    src, ckpt = scratch_path(spark, "vecs"), scratch_path(spark, "vecs-ckpt")
    first = minibatch.Centres(x[:3].copy(), np.zeros(3))
    _frame(spark, x[:120]).coalesce(1).write.parquet(src)
    state = online.learn_centres(spark, src, SCHEMA, "id", "vec", checkpoint=ckpt, first=first)
    _frame(spark, x[120:], ids=range(120, 240)).coalesce(1).write.mode("append").parquet(src)
    online.learn_centres(spark, src, SCHEMA, "id", "vec", state=state, checkpoint=ckpt, first=first)
    online.learn_centres(spark, src, SCHEMA, "id", "vec", state=state, checkpoint=ckpt, first=first)   # nothing new
    got = online.read_centres(spark, state)
    slow = _slow(*_slow(x[:3].copy(), np.zeros(3), x[:120]), x[120:])
    assert np.allclose(got.values, slow[0]) and got.weights.tolist() == slow[1].tolist()
    # the second batch run again starts from the centres after the first
    assert online.read_centres(spark, state, before=1).weights.sum() == 120
    own = online.learn_centres(spark, src, SCHEMA, "id", "vec", k=3)
    assert online.read_centres(spark, own).weights.sum() == 240


def test_clustering_by_the_method_of_the_settings(spark):
    x, own = _planted(200, d=3, k=3)
    settings = dataclasses.replace(DEFAULTS, cluster=dataclasses.replace(DEFAULTS.cluster, kmeans_method="minibatch"))
    found = pipeline.fit_predict(_frame(spark, x), "kmeans", 3, settings)
    pairs = {(own[r["id"]], r["cluster"]) for r in found.assignments["kmeans"].collect()}
    assert len(pairs) == 3 and found.metrics.first()["n_clusters"] == 3
