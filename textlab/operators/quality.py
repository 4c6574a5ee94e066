"""Cluster quality metrics (Q-1..Q-4), exact, on ``points(id, vec, cluster[, n])``.

``n`` (default 1) is how many equal rows a point stands for; every count, mean
and sum counts it, so the scores are those of the repeated rows.

Noise rows (cluster = -1) are dropped first; the three scores are NULL when
fewer than two clusters remain or when every remaining row is its own cluster
(the scores are undefined for ``n_clusters > n - 1``).

* silhouette: plain Euclidean, mean over rows, a singleton cluster scores 0;
  O(n^2) compute, all rows streamed past each block, one row out per block.
* Calinski-Harabasz: B (n-k) / (W (k-1)), 1.0 when W = 0.
* Davies-Bouldin: mean over clusters of max_j (s_i + s_j) / d_ij; 0 when all
  spreads or all centre distances are 0; a zero centre distance contributes 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.functions import vectors as V
from textlab.operators.blocks import Against, blocked_cogroup, euclidean, n_blocks_for, stack, streamed_blocks
from textlab.operators.common import cut_lineage

METRIC_SCHEMA = ("n_samples bigint, n_in_clusters bigint, n_clusters bigint, "
                 "silhouette double, calinski double, davies_bouldin double")


def _n(points: DataFrame) -> F.Column:
    return F.col("n").cast("bigint") if "n" in points.columns else F.lit(1).cast("bigint")


def counts(points: DataFrame) -> DataFrame:
    """Q-1: ``n_samples, n_in_clusters, n_clusters`` (exact distinct)."""
    inside = F.col("cluster") != -1
    n = _n(points)
    return points.agg(
        F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias("n_samples"),
        F.coalesce(F.sum(F.when(inside, n)), F.lit(0)).cast("bigint").alias("n_in_clusters"),
        F.countDistinct(F.when(inside, F.col("cluster"))).alias("n_clusters"),
    )


def centroids(points: DataFrame) -> DataFrame:
    """``(cluster, centre ARRAY<DOUBLE>, n BIGINT)`` via the JVM Summarizer."""
    n = _n(points)
    agg = points.groupBy("cluster").agg(
        Summarizer.metrics("mean").summary(array_to_vector(V.to_double("vec")), n.cast("double")).alias("s"),
        F.sum(n).alias("n"))
    return agg.select("cluster", vector_to_array(F.col("s.mean")).alias("centre"), "n")


# Sums by cluster that a task holds for its left block.
SUM_CELLS = 4_000_000
# Left blocks past which all rows are streamed, unless the sums or few rows ask for more or fewer: what is
# shuffled grows with the rows, not with their square.
LEFT_BLOCKS = 48


def silhouette(points: DataFrame, n_rows: int | None = None, block_rows: int = 2048,
               n_clusters: int | None = None) -> DataFrame:
    """Q-2: one row ``silhouette``; exact Euclidean mean silhouette.

    All rows are streamed past each left block, which keeps one sum of
    distances per row and cluster; a block gives one row. Blocks get smaller as
    clusters get more, so that the sums stay bounded.
    """
    pts = points.select(F.col("id").cast("bigint").alias("id"), V.to_double("vec").alias("vec"),
                        F.col("cluster").cast("bigint").alias("cluster"), _n(points).alias("n"))
    if n_rows is None or n_clusters is None:
        n_rows, n_clusters = pts.agg(F.count(F.lit(1)), F.countDistinct("cluster")).first()

    def prepare(left: pd.DataFrame) -> dict:
        return {"id": left["id"].values, "x": Against(stack(left["vec"])), "cluster": left["cluster"].values,
                "n": left["n"].values}

    def merge(block: dict, state, right: pd.DataFrame):
        known, sums, count = state or ({}, np.zeros((len(block["id"]), 0)), np.zeros(0))
        right = right.iloc[np.argsort(right["cluster"].values, kind="stable")]
        uniq, first = np.unique(right["cluster"].values, return_index=True)
        new = [c for c in uniq.tolist() if c not in known]
        known |= {c: len(known) + i for i, c in enumerate(new)}
        sums = np.concatenate([sums, np.zeros((len(sums), len(new)))], axis=1)
        count = np.concatenate([count, np.zeros(len(new))])
        n, ids = right["n"].values.astype(float), right["id"].values
        at = np.array([known[c] for c in uniq.tolist()])
        cuts = np.append(first, len(right))
        same = np.isin(ids, block["id"]).any()
        for i, j, d in block["x"].tiles(stack(right["vec"])):
            np.sqrt(d, out=d)
            if same:
                d[block["id"][i:i + len(d), None] == ids[None, j:j + d.shape[1]]] = 0.0
            for c in range(np.searchsorted(first, j, "right") - 1, np.searchsorted(first, j + d.shape[1])):
                a, b = max(cuts[c], j), min(cuts[c + 1], j + d.shape[1])
                sums[i:i + len(d), at[c]] += d[:, a - j:b - j] @ n[a:b]
        count[at] += np.add.reduceat(n, first)
        return known, sums, count

    def emit(block: dict, state) -> pd.DataFrame:
        known, sums, count = state
        own = np.array([known[c] for c in block["cluster"].tolist()])
        rows = np.arange(len(own))
        a = sums[rows, own] / np.maximum(1, count[own] - 1)
        mean = sums / count
        mean[rows, own] = np.inf
        b = mean.min(axis=1)
        top = np.maximum(a, b)
        s = np.where((count[own] <= 1) | (top == 0), 0.0, (b - a) / np.where(top == 0, 1.0, top))
        return pd.DataFrame({"s": [float((s * block["n"]).sum())], "n": [int(block["n"].sum())]})

    size = max(64, min(max(block_rows, -(-n_rows // LEFT_BLOCKS)), SUM_CELLS // max(1, n_clusters)))
    parts = streamed_blocks(pts, n_rows, size, prepare, merge, emit, "s double, n bigint")
    return parts.agg((F.sum("s") / F.sum("n")).alias("silhouette"))


def _db_partials(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    if left.empty or right.empty:
        return pd.DataFrame({"cluster": pd.Series([], dtype="int64"), "worst": pd.Series([], dtype="float64"),
                             "any_d": pd.Series([], dtype="bool")})
    d = euclidean(stack(left["centre"]), stack(right["centre"]))
    same = left["cluster"].values[:, None] == right["cluster"].values[None, :]
    num = left["spread"].values[:, None] + right["spread"].values[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where((d == 0) | same, 0.0, num / np.where(d == 0, 1.0, d))
    ratio[same] = -np.inf
    nonzero = np.where(same, False, d > 0).any(1)
    return pd.DataFrame({"cluster": left["cluster"].values.astype(np.int64),
                         "worst": ratio.max(1), "any_d": nonzero})


def _centre_table(stats: DataFrame) -> DataFrame:
    return stats.select(F.col("cluster").alias("id"), "cluster", "centre", "spread")


def evaluate(points: DataFrame, block_rows: int = 2048) -> DataFrame:
    """Q-1..Q-4 as one row with :data:`METRIC_SCHEMA`.

    Each score is a bounded one-row Spark aggregate; the row is assembled
    from those scalars. Centres are never collected (k may be large).
    """
    spark = points.sparkSession
    c = counts(points).first()
    n_samples, n_in, k = c["n_samples"], c["n_in_clusters"], c["n_clusters"]
    if k < 2 or k > n_in - 1:
        return spark.createDataFrame([(n_samples, n_in, k, None, None, None)], METRIC_SCHEMA)

    inside = points.where(F.col("cluster") != -1).select(
        F.col("id").cast("bigint").alias("id"), V.to_double("vec").alias("vec"),
        F.col("cluster").cast("bigint").alias("cluster"), _n(points).alias("n"))
    inside = cut_lineage(inside)   # read by every score below
    cents = centroids(inside)
    # equi-join on the cluster key; k rows on the small side (AQE broadcasts it
    # at runtime when it fits, else sort-merge)
    per_point = inside.join(cents.select("cluster", "centre"), "cluster").select(
        "cluster", inside["n"].alias("m"), V.sq_dist("vec", "centre").alias("sq"))
    per_cluster = per_point.groupBy("cluster").agg(
        F.sum(F.col("sq") * F.col("m")).alias("w"),
        (F.sum(F.sqrt("sq") * F.col("m")) / F.sum("m")).alias("spread"))
    stats = cents.join(per_cluster, "cluster").cache()

    # Calinski-Harabasz: overall mean is d numbers (bounded by the dimension)
    g = stats.select(F.posexplode("centre").alias("j", "x"), "n").groupBy("j") \
             .agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("g")).collect()
    gmean = F.array(*[F.lit(float(r["g"])) for r in sorted(g, key=lambda r: r["j"])])
    bw = stats.agg(F.sum(F.col("n") * V.sq_dist("centre", gmean)).alias("B"),
                   F.sum("w").alias("W")).first()
    calinski = 1.0 if bw["W"] == 0 else bw["B"] * (n_in - k) / (bw["W"] * (k - 1))

    # Davies-Bouldin: centre pairs handled block-wise, per-centre maxima only
    cent_tab = _centre_table(stats)
    worst = blocked_cogroup(cent_tab, cent_tab, n_blocks_for(k, block_rows), _db_partials,
                            "cluster bigint, worst double, any_d boolean", symmetric=True)
    db_row = worst.groupBy("cluster").agg(F.max("worst").alias("worst"),
                                          F.max(F.col("any_d").cast("int")).alias("any_d")) \
                  .agg(F.avg("worst").alias("db"), F.max("any_d").alias("any_d")).first()
    max_spread = stats.agg(F.max("spread")).first()[0]
    davies = 0.0 if (max_spread == 0 or not db_row["any_d"]) else db_row["db"]

    sil = silhouette(inside, None, block_rows).first()["silhouette"]
    stats.unpersist()
    return spark.createDataFrame([(n_samples, n_in, k, sil, calinski, davies)], METRIC_SCHEMA)
