"""Clustering over ``points(id, vec ARRAY<FLOAT|DOUBLE>[, cluster])``.

k-means and PCA are Spark ML estimators (distributed fit, JVM transform);
vectors cross into ``VectorUDT`` only at that boundary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.config import DEFAULTS, ClusterSettings
from textlab.functions import vectors as V
from textlab.operators.common import with_ordinal

ALGOS = ("kmeans", "hdbscan", "both")
# Largest centre matrix shipped to tasks (k x d doubles), checked before use.
CENTRE_BYTES_LIMIT = 256 * 1024 * 1024


def resolve_algo(algo: str | None, settings: ClusterSettings = DEFAULTS.cluster) -> tuple[str, ...]:
    """Case-insensitive ``kmeans`` / ``hdbscan`` / ``both``; anything else raises."""
    name = (algo or settings.default_algo).lower()
    if name not in ALGOS:
        raise ValueError(f"unknown clustering algorithm {algo!r}; use one of {ALGOS}")
    return ("kmeans", "hdbscan") if name == "both" else (name,)


def clamp_k(k: int | None, n: int, settings: ClusterSettings = DEFAULTS.cluster) -> int | None:
    """C3 clamp: ``min(max(2, k), n)``; None when that is below 2 (n < 2)."""
    kk = int(min(max(2, settings.kmeans_k if k is None else k), n))
    return kk if kk >= 2 else None


def gate(n_labels: int, settings=DEFAULTS.tags) -> str:
    """``clustered`` when there are enough labels, else ``skipped``."""
    return "clustered" if n_labels >= settings.min_labels_to_cluster else "skipped"


def gate_status(n_labels: F.Column, settings=DEFAULTS.tags) -> F.Column:
    """C1 over a column of label counts."""
    return F.when(n_labels >= settings.min_labels_to_cluster, "clustered").otherwise("skipped")


def cluster_sizes(points: DataFrame) -> DataFrame:
    """``(cluster, n)``; noise (-1) is a row like any other."""
    return points.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def _features(points: DataFrame) -> DataFrame:
    return points.withColumn("features", array_to_vector(V.to_double("vec")))


@dataclass
class KMeansResult:
    k: int
    model: KMeansModel
    assignments: DataFrame     # (id, cluster INT)
    cost: float


def kmeans(points: DataFrame, k: int | None = None, settings: ClusterSettings = DEFAULTS.cluster,
           weight_col: str | None = None, n_rows: int | None = None,
           max_iter: int = 20, partitions: int = 64) -> KMeansResult | None:
    """Spark ML k-means (k-means|| init, Lloyd), seed 42; None when k < 2.

    Input is dealt by a hash of ``id`` to ``partitions`` and sorted there, so the
    seeded initialisation depends neither on the upstream layout nor on the
    session's number of shuffle partitions (raise ``partitions`` with the data).
    """
    n = n_rows if n_rows is not None else points.count()
    kk = clamp_k(k, n, settings)
    if kk is None:
        return None
    feats = _features(points.repartition(partitions, "id").sortWithinPartitions("id")).cache()
    est = KMeans(k=kk, seed=settings.seed, maxIter=max_iter, featuresCol="features",
                 predictionCol="cluster")
    if weight_col:
        est = est.setWeightCol(weight_col)
    model = est.fit(feats)
    assign = model.transform(feats).select("id", F.col("cluster").cast("int").alias("cluster"))
    cost = float(model.summary.trainingCost)
    feats.unpersist()
    return KMeansResult(kk, model, assign, cost)


def centres_from_model(spark, model: KMeansModel) -> DataFrame:
    """``(cluster, centre ARRAY<DOUBLE>)`` from a fitted model (k rows, already on the driver)."""
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return spark.createDataFrame(rows, "cluster int, centre array<double>")


def nearest_centre(points: DataFrame, centres: DataFrame, out: str = "center") -> DataFrame:
    """C4: id of the nearest centre per point (ties -> smallest centre id).

    ``centres(cluster, centre)`` has k rows (k is a parameter); the k x d matrix
    is size-checked and shipped once per task, and distances are computed per
    Arrow batch in numpy - no join, no pairs table.
    """
    size = centres.agg(F.sum(F.size("centre").cast("bigint") * 8)).first()[0] or 0
    if size > CENTRE_BYTES_LIMIT:   # measured before anything is collected
        raise ValueError("centre matrix too large to ship to tasks; cluster with fewer centres")
    rows = centres.select(F.col("cluster").cast("long").alias("c"), V.to_double("centre").alias("v")) \
                  .orderBy("c").collect()
    if not rows:
        return points.select("id", F.lit(None).cast("int").alias(out))
    ids = np.array([r["c"] for r in rows], dtype=np.int64)
    mat = np.array([r["v"] for r in rows], dtype=np.float64)
    bc = points.sparkSession.sparkContext.broadcast((ids, mat))

    @F.pandas_udf(T.IntegerType())
    def _nearest(vecs: pd.Series) -> pd.Series:
        cids, m = bc.value
        if len(vecs) == 0:
            return pd.Series([], dtype="int32")
        x = np.stack([np.asarray(v, dtype=np.float64) for v in vecs.values])
        d = np.empty((x.shape[0], m.shape[0]))
        for j in range(m.shape[0]):
            diff = x - m[j]
            d[:, j] = np.einsum("ij,ij->i", diff, diff)
        return pd.Series(cids[np.argmin(d, axis=1)].astype("int32"))

    return points.select("id", _nearest(F.col("vec")).alias(out))


def reduce_dims(points: DataFrame, dims: int | None = None, settings: ClusterSettings = DEFAULTS.cluster,
                n_rows: int | None = None, normalize: bool = True) -> tuple[DataFrame, int]:
    """L2-normalise, then PCA to ``min(dims, d, n-1)`` when that is >= 2.

    Returns ``(points with vec replaced, used_dims)``; PCA's d x d covariance is
    formed on the driver (fine for d <= a few thousand).
    """
    n = n_rows if n_rows is not None else points.count()
    first = points.select(F.size("vec").alias("d")).first()
    d = first["d"] if first else 0
    target = min(dims or settings.reduced_dims, d, n - 1)
    feats = _features(points)
    if normalize:
        feats = Normalizer(inputCol="features", outputCol="normed", p=2.0).transform(feats) \
            .drop("features").withColumnRenamed("normed", "features")
    if target < 2:
        return feats.withColumn("vec", vector_to_array("features")).drop("features"), d
    model = PCA(k=target, inputCol="features", outputCol="reduced").fit(feats)
    out = model.transform(feats).withColumn("vec", vector_to_array("reduced")).drop("features", "reduced")
    return out, target


def attach(docs: DataFrame, assignments: DataFrame, algo: str, key: str = "ord") -> DataFrame:
    """Every input row with its cluster (long form ``algo, ord, cluster``)."""
    a = assignments.select(F.col("id").alias(key), "cluster")
    return docs.select(key).join(a, key, "left").select(F.lit(algo).alias("algo"), key, "cluster")


def color_map(points: DataFrame, n_colors: int = 10) -> DataFrame:
    """G1 colours: rank of the sorted non-noise cluster ids, modulo ``n_colors``.

    ``(cluster, is_noise, color_idx)``; noise gets NULL. The rank is a
    distributed ordinal over the distinct cluster ids.
    """
    distinct = points.select("cluster").distinct()
    real = with_ordinal(distinct.where(F.col("cluster") != -1), ["cluster"], name="rk")
    colored = real.select("cluster", F.lit(False).alias("is_noise"),
                          ((F.col("rk") - 1) % n_colors).cast("int").alias("color_idx"))
    noise = distinct.where(F.col("cluster") == -1).select(
        "cluster", F.lit(True).alias("is_noise"), F.lit(None).cast("int").alias("color_idx"))
    return colored.unionByName(noise)


def projection_2d(points: DataFrame, n_colors: int = 10, budget: int | None = None,
                  seed: int = 42) -> DataFrame:
    """G1: plot-ready ``(id, x, y, cluster, is_noise, color_idx)`` via PCA(2); no image drawn.

    ``budget`` (optional) caps the points drawn: every cluster keeps a seeded,
    hash-based sample of about ``budget / n_clusters`` rows (all rows of a
    smaller cluster), so a huge cluster cannot crowd out the others. Sampling
    is the feature here (a picture), never used for the analysis itself.
    """
    feats = _features(points)
    model = PCA(k=2, inputCol="features", outputCol="xy").fit(feats)
    xy = model.transform(feats).select("id", "cluster", vector_to_array("xy").alias("xy"))
    if budget is not None:
        sizes = points.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_c"))
        k = max(1, sizes.count())   # number of clusters: a small action
        per = float(budget) / k
        frac = sizes.select("cluster", F.least(F.lit(1.0), F.lit(per) / F.col("n_c")).alias("f"))
        u = F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(1000000)) / F.lit(1000000.0)
        xy = xy.join(frac, "cluster").where(u < F.col("f")).drop("f")
    colors = color_map(points, n_colors)
    return xy.join(colors, "cluster", "left").select(
        "id", F.col("xy")[0].alias("x"), F.col("xy")[1].alias("y"), "cluster", "is_noise", "color_idx")
