"""Embedding whitening by a bidiagonal qd solver (operator 13).

The centred rows of the fit list go block by block through QR: each task keeps
one triangle R, tasks' triangles are stacked and reduced in a tree, and one
triangle of the vectors' width is left, with the singular values and right
singular vectors of all rows. The driver turns it into a bidiagonal by
Householder reflections, finds the squared singular values by dqds (differential
quotient-difference with shifts, which keeps small ones accurate) and their
directions by twisted factorisations of the bidiagonal's normal matrix; groups
of close values get a representation shifted next to them first, in which they
lie far apart. Work on the driver depends on the width alone.

Vectors are numbers x = floor(64*c) + 1000000, so counts, sums and n*x - S are
whole and centring loses nothing to the large offset. The fit list is each
distinct vector once: copies are dropped before and after the shuffle.

Cases: rows whose vector is null, empty or holds null or non-finite entries, or has
another width than most vectors (of equally usual widths the largest), get no
result. Repeated rows each get theirs. Components are those of positive
variance, TOP at most: none if all vectors are equal. A deviation beyond a long
is null. No usable row: no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.llm.common import tidy, written

TOP, SCALE, OFFSET = 16, 64, 1_000_000
#: Rows of a block that goes into QR, and triangles that are stacked at a time.
BLOCK, FAN = 2048, 16
EPS = float(np.finfo(float).eps)
#: Values closer than this part of themselves are a group.
CLOSE = 1e-3


# ---- the bidiagonal ---------------------------------------------------------------------------------------

def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """(diagonal, superdiagonal, back): Householder reflections from both sides turn the square r into an upper
    bidiagonal; ``back`` takes right singular vectors of that (as columns) to those of r."""
    a, d = r.astype(float).copy(), len(r)
    right = []

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        size = np.abs(x).max(initial=0.0)
        if size == 0 or len(x) < 2:
            return np.zeros_like(x), float(x[0]) if len(x) else 0.0
        v = x / size
        alpha = -math.copysign(float(np.sqrt(v @ v)), v[0])
        v[0] -= alpha
        norm = float(np.sqrt(v @ v))
        return (v / norm if norm else v), alpha * size

    for k in range(d):
        v, a_kk = reflector(a[k:, k].copy())
        a[k:, k + 1:] -= 2 * np.outer(v, v @ a[k:, k + 1:])
        a[k, k] = a_kk
        u, a_next = reflector(a[k, k + 1:].copy())
        if k + 1 < d:
            a[k + 1:, k + 1:] -= 2 * np.outer(a[k + 1:, k + 1:] @ u, u)
            a[k, k + 1] = a_next
        right.append(u)

    def back(z: np.ndarray) -> np.ndarray:
        z = z.copy()
        for k in range(d - 1, -1, -1):
            z[k + 1:] -= 2 * np.outer(right[k], right[k] @ z[k + 1:])
        return z

    return np.diag(a).copy(), np.diag(a, 1).copy(), back


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values, falling, of the upper bidiagonal with diagonal a and superdiagonal b.

    The shift of a sweep is the Newton bound 1/trace of the inverse, which no squared singular value is below, so
    qd numbers stay positive; each sweep keeps every value to high relative accuracy.
    """
    tiny = (10 * EPS) ** 2
    found: list[float] = []
    todo = [([float(x) ** 2 for x in a], [float(x) ** 2 for x in b], 0.0)]
    while todo:
        q, e, sigma = todo.pop()
        while q:
            n = len(q)
            if n == 1:
                found.append(q.pop() + sigma)
                break
            if e[-1] <= tiny * (sigma + q[-1]) or e[-1] <= tiny * q[-2] * q[-1] / (q[-2] + q[-1] or 1):
                found.append(q.pop() + sigma)
                e.pop()
                continue
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= tiny * min(q[i], q[i + 1])), None)
            if cut is not None:
                todo.append((q[cut + 1:], e[cut + 1:], sigma))
                q, e = q[:cut + 1], e[:cut]
                continue
            if min(q) <= 0:  # singular: a sweep without a shift brings the zero to the end, another cuts it off
                q, e = _sweep(*_sweep(q, e, 0.0), 0.0)
                continue
            if q[0] < q[-1] / 2:  # the small end belongs last: the same values from the other side
                q, e = q[::-1], e[::-1]
            d, inverse = q[0], 1 / q[0]
            for i in range(n - 1):
                d = d * (q[i + 1] / (d + e[i]))
                inverse += 1 / d if d else math.inf
            shift = (1 - 4 * n * EPS) / inverse
            new = _sweep(q, e, shift) if sigma + shift != sigma else None
            while new is None:
                shift = shift / 4 if sigma + shift / 4 != sigma and shift else 0.0
                new = _sweep(q, e, shift)
            q, e = new
            sigma += shift
    return np.sort(np.array(found))[::-1]


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One differential qd step; None if the shift is too large."""
    qs, es, d = [], [], q[0] - shift
    for i in range(len(e)):
        if d < 0:
            return None
        s = d + e[i]
        t = q[i + 1] / s if s else 0.0
        qs.append(s)
        es.append(e[i] * t)
        d = d * t - shift
    if d < 0:
        return None
    qs.append(d)
    return qs, es


# ---- directions -------------------------------------------------------------------------------------------

def _stationary(d: np.ndarray, l: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: E741
    """L+ D+ L+' = L D L' - shift, and the s of each row."""
    n = len(d)
    dp, lp, s = np.empty(n), np.empty(n - 1), np.empty(n)
    x = -shift
    for i in range(n):
        s[i] = x
        dp[i] = d[i] + x or EPS * EPS * max(abs(d[i]), 1e-300)
        if i < n - 1:
            lp[i] = d[i] * l[i] / dp[i]
            x = lp[i] * l[i] * x - shift
    return dp, lp, s


def _progressive(d: np.ndarray, l: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: E741
    """U- R- U-' = L D L' - shift from below, and the p of each row."""
    n = len(d)
    rm, um, p = np.empty(n), np.empty(n - 1), np.empty(n)
    x = d[-1] - shift
    for i in range(n - 1, 0, -1):
        p[i] = x
        rm[i] = d[i - 1] * l[i - 1] ** 2 + x or EPS * EPS * max(abs(d[i - 1]), 1e-300)
        t = d[i - 1] / rm[i]
        um[i - 1] = l[i - 1] * t
        x = x * t - shift
    p[0] = rm[0] = x
    return rm, um, p


def twisted(d: np.ndarray, l: np.ndarray, value: float) -> tuple[np.ndarray, float]:  # noqa: E741
    """(direction, correction of the value) from the factorisation from both ends that meets where it is smallest."""
    n = len(d)
    _, lp, s = _stationary(d, l, value)
    _, um, p = _progressive(d, l, value)
    gamma = s + p + value
    r = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -lp[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -um[i] * z[i]
    size = float(z @ z)
    return z / math.sqrt(size), float(gamma[r]) / size


def _below(d: np.ndarray, l: np.ndarray, x: float) -> int:  # noqa: E741
    """How many values of L D L' are less than x."""
    return int((_stationary(d, l, x)[0] < 0).sum())


def _refined(d: np.ndarray, l: np.ndarray, k: int, guess: float, step: float) -> float:  # noqa: E741
    """The k-th smallest value of L D L' by bisection around a guess."""
    low, high, step = guess - step, guess + step, max(step, abs(guess) * EPS)
    while _below(d, l, low) > k:
        low, step = low - step, 2 * step
    while _below(d, l, high) <= k:
        high, step = high + step, 2 * step
    while high - low > 2 * EPS * max(abs(low), abs(high)):
        middle = low + (high - low) / 2
        if middle in (low, high):
            break
        if _below(d, l, middle) > k:
            high = middle
        else:
            low = middle
    return low + (high - low) / 2


def directions(d: np.ndarray, l: np.ndarray, values: list[float], numbers: list[int], depth: int = 0) -> list[np.ndarray]:  # noqa: E741
    """Unit directions of the values (rising; ``numbers`` are their places among all) of L D L'."""
    out, begin = [], 0
    while begin < len(values):
        end = begin + 1
        while end < len(values) and values[end] - values[end - 1] < CLOSE * max(abs(values[end]), abs(values[end - 1])):
            end += 1
        group, places = values[begin:end], numbers[begin:end]
        if len(group) == 1 or depth == 8:
            for v in group:
                for _ in range(3):
                    z, correction = twisted(d, l, v)
                    if not abs(correction) > 2 * EPS * abs(v):
                        break
                    v += correction
                out.append(z)
        else:
            width = max(group[-1] - group[0], 4 * EPS * abs(group[0]))
            shift = group[0] - width / 8
            dp, lp, _ = _stationary(d, l, shift)
            error = 8 * len(d) * EPS * abs(shift)
            near = [_refined(dp, lp, k, v - shift, error) for k, v in zip(places, group, strict=True)]
            out += directions(dp, lp, near, places, depth + 1)
        begin = end
    return out


def singular(r: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values, right singular vectors as columns) of the square r, the ``top`` largest that are
    positive to working precision."""
    n = len(r)
    scale = float(np.abs(r).max(initial=0.0))
    if not scale:
        return np.zeros(0), np.zeros((n, 0))
    a, b, back = bidiagonal(r / scale)
    size = max(np.abs(a).max(), np.abs(b).max(initial=0.0))
    b[np.abs(b) <= EPS * size] = 0.0
    found: list[tuple[float, np.ndarray]] = []
    edges = [0, *(np.flatnonzero(b == 0) + 1).tolist(), n]
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):  # parts that no superdiagonal joins
        x = np.where(np.abs(a[lo:hi]) <= EPS * size, EPS * size / 8, a[lo:hi])
        y = b[lo:hi - 1]
        values = dqds(x, y)[::-1]
        first = max(0, len(values) - top)
        for value, z in zip(values[first:], directions(x * x, y / x[:-1], values[first:].tolist(),
                                                       list(range(first, len(values)))), strict=True):
            full = np.zeros(n)
            full[lo:hi] = z
            found.append((float(value), full))
    found = sorted(found, key=lambda f: -f[0])[:top]
    found = [f for f in found if f[0] > (n * EPS * size) ** 2]
    vectors = np.zeros((n, len(found)))
    for k, (_, z) in enumerate(found):
        vectors[:, k] = z
    for k in range(len(found)):  # what rounding left of close neighbours
        for j in range(k):
            vectors[:, k] -= vectors[:, j] * (vectors[:, j] @ vectors[:, k])
        vectors[:, k] /= np.sqrt(vectors[:, k] @ vectors[:, k])
    return np.array([f[0] for f in found]) * scale ** 2, back(vectors)


# ---- on Spark ---------------------------------------------------------------------------------------------

def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, fine), F.lit(False))


def whole(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(OFFSET).cast("long"))


def matrices(column: pa.Array) -> np.ndarray:
    """Arrays of longs of one width as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n*x - S, as longs where they fit, else as Python's whole numbers."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max(map(abs, sums))
    if most < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def reduced(df: DataFrame, column: str, first: Callable, merge: Callable, schema: str, name: str) -> list:
    """Partials of each partition (``first`` over its Arrow batches' column), merged FAN at a time in a tree until
    at most FAN are left, which the driver gets: a partial's size does not depend on the rows."""
    def start(batches):
        out = first(batch.column(0) for batch in batches if batch.num_rows)
        tidy()
        if out is not None:
            yield pa.RecordBatch.from_pylist([out])

    def join(key, table):
        return pa.Table.from_pylist([{**merge(table.to_pylist()), "__part": key[0].as_py()}])

    level = written(df.select(column).mapInArrow(start, schema).withColumn(
        "__part", F.spark_partition_id().cast("long")), name)
    while level.count() > FAN:
        group = F.floor(F.col("__part") / FAN)
        level = written(level.withColumn("__part", group).groupBy("__part")
                        .applyInArrow(join, f"{schema}, __part long"), name)
    return [r.asDict() for r in level.drop("__part").collect()]


def triangle(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the QR factorisation of all centred rows, square."""
    d = len(sums)

    def qr(blocks) -> np.ndarray:
        r = np.zeros((0, d))
        for block in blocks:
            r = np.linalg.qr(np.concatenate([r, block]), mode="r")
        return r

    def first(columns):
        rows = ((centred(x[i:i + BLOCK], n, sums) / n).astype(float)
                for x in map(matrices, columns) for i in range(0, len(x), BLOCK))
        r = qr(rows)
        return {"r": r.ravel().tolist()} if len(r) else None

    def merge(parts):
        return {"r": qr(np.array(p["r"]).reshape(-1, d) for p in parts).ravel().tolist()}

    left = reduced(fit, "x", first, merge, "r array<double>", "triangles")
    r = qr(np.array(p["r"]).reshape(-1, d) for p in left)
    return np.concatenate([r, np.zeros((d - len(r), d))])


class Whitening:
    """What was fitted: n and S of the fit list, directions (columns) and variances, and their parts of the trace."""

    def __init__(self, n: int, sums: list[int], directions_: np.ndarray, variances: np.ndarray, trace: float):
        self.n, self.sums, self.trace = n, sums, trace
        self.directions, self.variances = directions_, variances
        self.explained = variances / trace if trace else variances

    def project(self, x: np.ndarray) -> np.ndarray:
        c = (centred(x, self.n, self.sums) / self.n).astype(float)
        return c @ self.directions / np.sqrt(self.variances)


def prepared(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows with a usable vector of the usual width, and x."""
    fine = rows.where(usable(F.col(f"`{vector}`")))
    width = fine.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n")) \
        .orderBy(F.desc("n"), F.desc("d")).first()
    if width is None:
        return rows.where("false").withColumn("x", F.lit(None).cast("array<bigint>"))
    return fine.where(F.size(vector) == width["d"]).withColumn("x", whole(F.col(f"`{vector}`")))


def fit(x_rows: DataFrame, top: int = TOP) -> tuple[Whitening | None, DataFrame]:
    """(what was fitted on the distinct x, those): None without rows."""
    distinct = written(x_rows.select("x").distinct(), "fit")
    sums = distinct.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(
        F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).orderBy("pos").collect()
    if not sums:
        return None, distinct
    n, s = sums[0]["n"], [int(r["s"]) for r in sums]
    r = triangle(distinct, n, s)
    squares, vectors = singular(r, top)
    return Whitening(n, s, vectors, squares / n, float((r * r).sum()) / n), distinct


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest entry (absolute) of the whitened fit list's covariance less the identity.

    Blocks are centred on their own mean before multiplying; two partials are joined with their means' difference.
    """
    k = len(model.variances)
    if not k:
        return 0.0

    def merge(parts):
        n, mean, square = 0, np.zeros(k), np.zeros((k, k))
        for p in parts:
            m, apart = p["n"], np.array(p["mean"]) - mean
            square += np.array(p["square"]).reshape(k, k) + np.outer(apart, apart) * (n * m / (n + m))
            mean = mean + apart * (m / (n + m))
            n += m
        return {"n": n, "mean": mean.tolist(), "square": square.ravel().tolist()}

    def one(w):
        mean = w.mean(axis=0)
        return {"n": len(w), "mean": mean, "square": (w - mean).T @ (w - mean)}

    def first(columns):
        parts = (one(model.project(x[i:i + BLOCK])) for x in map(matrices, columns) for i in range(0, len(x), BLOCK))
        out = merge(parts)
        return out if out["n"] else None

    left = reduced(distinct, "x", first, merge, "n long, mean array<double>, square array<double>", "moments")
    total = merge(left)
    return float(np.abs(np.array(total["square"]).reshape(k, k) / total["n"] - np.eye(k)).max())


def whiten(rows: DataFrame, vector: str = "embedding", top: int = TOP) -> DataFrame:
    """The usable rows with ``whitened`` (array of the components' values), ``deviation`` (n*x - S squared and summed),
    and of the fit: ``n``, ``explained`` (array) and ``identity_error``."""
    gone = {"whitened", "deviation", "n", "explained", "identity_error", "x"}
    found = prepared(rows.select(*[F.col(f"`{c}`") for c in rows.columns if c == vector or c.lower() not in gone]), vector)
    model, distinct = fit(found, top)
    error = identity_error(distinct, model) if model else 0.0
    new = [T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.LongType())]
    schema = T.StructType([*found.drop("x").schema.fields, *new])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = matrices(part.column(part.num_columns - 1))
                if not len(x):
                    continue
                c = centred(x, model.n, model.sums)
                big = float(np.abs(c.astype(float)).max(initial=0.0)) ** 2 * c.shape[1] >= 2 ** 62
                far = [int(v) if v < 1 << 63 else None for v in (c.astype(object) ** 2 if big else c * c).sum(axis=1)]
                w = model.project(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]),
                                                 pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, pa.array(far, pa.int64())],
                                                 names=[f.name for f in schema])
        tidy()

    whitened = found.mapInArrow(run, schema)
    parts = [float(v) for v in model.explained] if model else []
    return whitened.withColumn("n", F.lit(model.n if model else 0).cast("long")) \
        .withColumn("explained", F.array(*[F.lit(v) for v in parts]).cast("array<double>")) \
        .withColumn("identity_error", F.lit(error))
