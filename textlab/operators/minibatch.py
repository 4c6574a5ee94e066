"""Mini-batch k-means (C3) over ``points(id, vec ARRAY<FLOAT|DOUBLE>[, weight])``.

Every centre has a learning rate of its own, one over the weight it has seen
(Sculley, 2010): a batch moves it towards the mean of its new rows. Two ways to feed batches:

* :func:`fit` starts from scratch. The updates of one start follow one another, so several starts run
  side by side as tasks, each over its own hash-ordered batches of at most 1,024 rows; their rows are bounded by
  parameters, whatever the table. One pass over all rows then measures every start, and the best one assigns them.
* :func:`learn` moves given centres by one batch of any size, as a Spark aggregate; a stream calls it
  once a micro-batch (``streaming.online.learn_centres``).

Rows with a NULL vector take no part and get no cluster. An empty table has no
fit (None). Repeated rows count as often as they occur; a weight (not negative)
says how many rows a point stands for. Equal distances go to the smaller centre number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.config import DEFAULTS, ClusterSettings
from textlab.functions import vectors as V
from textlab.operators import cluster

BATCH = 1024          # rows of a batch, as in the behaviour reproduced
STARTS = 3            # independent starts
STEPS = 60            # batches of a start at most, and so STARTS * STEPS * BATCH rows in all
EPOCHS = 20           # passes over a table smaller than that
INIT_BATCHES = 3      # batches from which the first centres are drawn
_UNIT = 1 << 30


@dataclass
class Centres:
    """k centres and the weight that each has seen (k x d doubles on the driver; k is a parameter)."""
    values: np.ndarray
    weights: np.ndarray

    def table(self, spark) -> DataFrame:
        """``(cluster, centre, weight)``"""
        rows = [(i, [float(x) for x in c], float(w)) for i, (c, w) in enumerate(zip(self.values, self.weights))]
        return spark.createDataFrame(rows, "cluster int, centre array<double>, weight double")

    @staticmethod
    def of(table: DataFrame) -> Centres:
        rows = sorted(table.collect(), key=lambda r: r["cluster"])
        return Centres(np.array([r["centre"] for r in rows], float), np.array([r["weight"] for r in rows], float))


@dataclass
class MiniBatchResult:
    k: int
    centres: Centres
    cost: float                # weighted sum of squared distances, all rows
    assignments: DataFrame     # (id, cluster INT)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre and squared distance, each row for itself (not by dot products, whose
    rounding depends on the rows around)."""
    best, at = np.full(len(x), np.inf), np.zeros(len(x), dtype=np.int64)
    for j, c in enumerate(centres):
        diff = x - c
        d = np.einsum("ij,ij->i", diff, diff)
        closer = d < best
        best[closer], at[closer] = d[closer], j
    return at, best


def moved(centres: np.ndarray, seen: np.ndarray, sums: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres after a batch that gave each of them rows of these weights and weighted sums."""
    total = seen + weights
    rate = np.divide(1.0, total, out=np.zeros_like(total), where=weights > 0)
    return centres + (sums - weights[:, None] * centres) * rate[:, None], total


def first_centres(x: np.ndarray, w: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++: rows drawn by weight times squared distance, the best of a few draws each time."""
    def draw(p, size):
        total = p.sum()
        if not total > 0:     # fewer than k different rows
            p, total = np.ones(len(p)), float(len(p))
        return np.minimum(np.searchsorted(np.cumsum(p) / total, rng.random(size), side="right"), len(p) - 1)

    chosen = [x[draw(w, 1)[0]]]
    left = nearest(x, np.array(chosen))[1]
    for _ in range(1, k):
        tried = []
        for i in draw(w * left, 2 + int(np.log(k))):
            after = np.minimum(left, nearest(x, x[i:i + 1])[1])
            tried.append((float((w * after).sum()), int(i), after))
        _, i, left = min(tried, key=lambda t: t[:2])
        chosen.append(x[i])
    return np.array(chosen)


def _points(points: DataFrame, weight_col: str | None) -> DataFrame:
    weight = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    return points.where(F.col("vec").isNotNull()).select("id", V.to_double("vec").alias("vec"), weight.alias("w"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    v = batch.column("vec")
    return v.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64, copy=False)


_FITTED = "start int, cluster int, weight double, centre array<double>"
_FITTED_ARROW = pa.schema([("start", pa.int32()), ("cluster", pa.int32()), ("weight", pa.float64()),
                           ("centre", pa.list_(pa.float64()))])


def _fit_rows(k: int, batch: int, init: int, seed: int, learning: bool):
    """Task of :func:`fit`: rows come by start and order; memory holds the first batches or one batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def step(now):
            rows = now["rows"]
            now["rows"], now["n"] = [], 0
            x, w = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
            if now["centres"] is None:
                rng = np.random.default_rng([seed, now["start"]])
                now["centres"], now["seen"] = first_centres(x, w, k, rng), np.zeros(k)
                if not learning:
                    return
            for at in range(0, len(x), batch):
                xb, wb = x[at:at + batch], w[at:at + batch]
                own = nearest(xb, now["centres"])[0]
                sums = np.zeros_like(now["centres"])
                np.add.at(sums, own, xb * wb[:, None])
                now["centres"], now["seen"] = moved(now["centres"], now["seen"], sums,
                                                    np.bincount(own, wb, minlength=k))

        def result(now):
            if now["n"]:
                step(now)
            return pa.RecordBatch.from_arrays(
                [pa.array([now["start"]] * k, pa.int32()), pa.array(range(k), pa.int32()),
                 pa.array(now["seen"]), pa.array(list(now["centres"]), pa.list_(pa.float64()))],
                schema=_FITTED_ARROW)

        for b in batches:
            if not b.num_rows:
                continue
            x, w, starts = _matrix(b), b.column("w").to_numpy(), b.column("start").to_numpy()
            for i in range(b.num_rows):
                if state is None or state["start"] != starts[i]:
                    if state is not None:
                        yield result(state)
                    state = {"start": int(starts[i]), "rows": [], "n": 0, "centres": None, "seen": None}
                state["rows"].append((x[i], w[i]))
                state["n"] += 1
                if state["n"] == (batch if state["centres"] is not None else init):
                    step(state)
        if state is not None:
            yield result(state)
    return run


def _starts(pts: DataFrame, n: int, k: int, seed: int, starts: int, steps: int, epochs: int, batch: int,
            learning: bool = True) -> list[Centres]:
    """The centres that each start ends with: one job, a task a start."""
    init = max(INIT_BATCHES * batch, 3 * k)
    rows = max(steps * batch, init)
    passes = max(1, min(epochs, rows // n))
    cut = min(_UNIT, -(-_UNIT * rows // (n * passes)))     # share of the rows that a pass takes
    # numbers of (start, pass) that take the row, each by a hash of its own; rows not taken never leave the scan
    taken = F.filter(F.sequence(F.lit(0), F.lit(starts * passes - 1)),
                     lambda s: F.pmod(F.xxhash64("id", F.lit(seed), s), F.lit(_UNIT)) < cut)
    turns = pts.select("*", F.explode(taken).alias("turn")) \
        .withColumn("start", F.floor(F.col("turn") / passes).cast("int")) \
        .withColumn("place", F.xxhash64("id", F.lit(seed + 1), "turn"))
    ordered = turns.repartition(starts, "start").sortWithinPartitions("start", "turn", "place", "id", "w", "vec")
    found = ordered.select("start", "w", "vec").mapInArrow(_fit_rows(k, batch, init, seed, learning), _FITTED).collect()
    by_start: dict[int, list] = {}
    for r in sorted(found, key=lambda r: (r["start"], r["cluster"])):
        by_start.setdefault(r["start"], []).append(r)
    return [Centres(np.array([r["centre"] for r in rs], float), np.array([r["weight"] for r in rs], float))
            for _, rs in sorted(by_start.items())]


def costs(points: DataFrame, candidates: list[Centres], weight_col: str | None = None) -> list[float]:
    """Weighted sum of squared distances of all rows to the nearest centre, for each set of centres: one pass."""
    shipped = points.sparkSession.sparkContext.broadcast([c.values for c in candidates])

    def measured(batches):
        totals = np.zeros(len(shipped.value))
        for b in batches:
            if b.num_rows:
                x, w = _matrix(b), b.column("w").to_numpy()
                totals += [float((nearest(x, c)[1] * w).sum()) for c in shipped.value]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(totals)), pa.int32()), pa.array(totals)],
                                         names=["start", "cost"])

    sums = _points(points, weight_col).select("w", "vec").mapInArrow(measured, "start int, cost double") \
        .groupBy("start").agg(F.sum("cost").alias("cost")).collect()
    shipped.destroy()
    by = {r["start"]: r["cost"] for r in sums}
    return [by.get(i, 0.0) for i in range(len(candidates))]


def _check_size(k: int, d: int, starts: int = 1) -> None:
    if k * d * 8 * starts > cluster.CENTRE_BYTES_LIMIT:
        raise ValueError("centre matrix too large to ship to tasks; cluster with fewer centres or starts")


def _shape(pts: DataFrame) -> tuple[int, int, int]:
    low, high, n = pts.agg(F.min(F.size("vec")), F.max(F.size("vec")), F.count(F.lit(1))).first()
    if low != high:
        raise ValueError(f"vectors of different lengths: {low} to {high}")
    return n, low or 0, high or 0


def fit(points: DataFrame, k: int | None = None, settings: ClusterSettings = DEFAULTS.cluster,
        weight_col: str | None = None, starts: int = STARTS, steps: int = STEPS, epochs: int = EPOCHS,
        batch: int = BATCH) -> MiniBatchResult | None:
    """Centres by mini-batches and the cluster of every row; None when there are fewer than 2 rows.

    ``k`` is clamped to ``min(max(2, k), n)``, a batch has ``min(batch, n)`` rows. Which rows a batch has depends on
    their ids and the settings' seed alone, so neither layout nor session settings change the centres.
    """
    pts = _points(points, weight_col)
    n, d, _ = _shape(pts)
    kk = cluster.clamp_k(k, n, settings)
    if kk is None:
        return None
    _check_size(kk, d, starts)
    batch = min(batch, n)
    ran = _starts(pts, n, kk, settings.seed, starts, steps, epochs, batch)
    cost = costs(points, ran, weight_col)
    # equal but for rounding: the first start
    best = min(range(len(ran)), key=lambda i: (float(f"{cost[i]:.9g}"), i))
    return MiniBatchResult(kk, ran[best], cost[best], assign(points, ran[best]))


def start(points: DataFrame, k: int | None = None, settings: ClusterSettings = DEFAULTS.cluster,
          weight_col: str | None = None, batch: int = BATCH) -> Centres | None:
    """First centres (k-means++ over about three batches of the rows) that have seen no rows yet."""
    pts = _points(points, weight_col)
    n, d, _ = _shape(pts)
    kk = cluster.clamp_k(k, n, settings)
    if kk is None:
        return None
    _check_size(kk, d)
    found = _starts(pts, n, kk, settings.seed, 1, INIT_BATCHES, 1, min(batch, n), learning=False)
    return Centres(found[0].values, np.zeros(kk))


def learn(centres: Centres, points: DataFrame, weight_col: str | None = None) -> Centres:
    """Centres after one batch, which may be of any size: tasks send a sum a centre, Spark adds them up."""
    k, d = centres.values.shape
    _check_size(k, d)
    shipped = points.sparkSession.sparkContext.broadcast(centres.values)

    def sums(batches):
        s, n = np.zeros((k, d)), np.zeros(k)
        for b in batches:
            if b.num_rows:
                x, w = _matrix(b), b.column("w").to_numpy()
                own = nearest(x, shipped.value)[0]
                np.add.at(s, own, x * w[:, None])
                n += np.bincount(own, w, minlength=k)
        # component d of a centre is its weight
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()),
                                          pa.array(list(np.column_stack([s, n])), pa.list_(pa.float64()))],
                                         names=["cluster", "sums"])

    rows = _points(points, weight_col).select("w", "vec").mapInArrow(sums, "cluster int, sums array<double>") \
        .select("cluster", F.posexplode("sums").alias("j", "x")) \
        .groupBy("cluster", "j").agg(F.sum("x").alias("x")).collect()     # k * (d + 1) numbers
    shipped.destroy()
    total = np.zeros((k, d + 1))
    for r in rows:
        total[r["cluster"], r["j"]] = r["x"]
    return Centres(*moved(centres.values, centres.weights, total[:, :d], total[:, d]))


def assign(points: DataFrame, centres: Centres) -> DataFrame:
    """``(id, cluster)``: the nearest centre of every row that has a vector."""
    spark = points.sparkSession
    return cluster.nearest_centre(points.where(F.col("vec").isNotNull()).select("id", "vec"),
                                  centres.table(spark).drop("weight"), out="cluster")
