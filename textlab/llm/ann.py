"""Approximate nearest neighbours by multiprobe p-stable hashing (operator 7).

Nearness is the inner product. Vectors are lifted by one component so that all
have the length of the longest; among lifted vectors, the largest inner product
with a query is the smallest Euclidean distance. Each of TABLES hash tables has
DEPTH p-stable functions floor((a.x + b) / w). A query visits buckets of a
table in the order of their estimated success: the sum of squared distances
from the query's projections to the bucket's sides. It goes on until the
buckets visited hold the share of all vectors that a bounded sample needed for
TARGET of its true neighbours. Candidates of all tables are merged, and ranked
by exact inner products in double precision.

Every row is indexed: a table's rows are dealt to tasks by their first
functions' values (a block), and a block of many rows by vec_id into pieces of
about PIECE rows, so that one crowded bucket is split too. Equal vectors in a
piece are one bucket entry with their smallest top+1 ids, which is all that any
query can get of them. A query goes to a block only if some bucket there is
within its limit.

Sample (fitted on the driver, bounded): the SAMPLE vectors and TRIALS queries of
smallest hash of their id.

Cases: vectors that are null, zero, or hold null or non-finite components take
no part, as queries or candidates; vectors of different lengths are not
compared. A null id takes no part. Repeated rows are one vector; of one id with
several vectors, each row is a candidate and the best counts. A query gets all
candidates if there are fewer than asked for. No rows give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlab.llm.common import written

TABLES, DEPTH, TARGET = 2, 12, 0.96
SAMPLE, TRIALS = 10_000, 200
#: Width of a hash function's cells, in standard deviations of projections.
WIDTH = 2.8
#: Cells of a function: values beyond the outermost belong to it.
CELLS = 3
#: Indexed rows of a task, about; queries scored at a time.
PIECE, QUERIES = 20_000, 64


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 0), np.float32)


class Index:
    """Hash functions, fitted on a sample."""

    def __init__(self, sample: np.ndarray, queries: np.ndarray, longest: float, count: int, top: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.longest = longest
        lifted = self.lift(sample)
        self.dim = lifted.shape[1]
        self.a = rng.normal(size=(TABLES, self.dim, DEPTH))
        projected = np.einsum("nd,tdk->tnk", lifted, self.a)
        self.w = WIDTH * projected.std(axis=1) + 1e-9  # (tables, depth)
        middle = projected.mean(axis=1)
        self.b = self.w * (rng.uniform(0, 1, self.w.shape) + (CELLS - 1) / 2) - middle
        self.cells = self.cell(lifted)  # of the sample, (tables, n, depth)
        #: Functions whose values make a block: as many as give blocks of about PIECE rows.
        self.front = max(1, min(DEPTH, math.ceil(math.log(max(1, count / PIECE), CELLS))))
        self.share = self.fit(sample, queries, top)

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        x = np.asarray(x, np.float64)
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, self.longest**2 - (x * x).sum(axis=1)))
        if query:  # a query's length doesn't change its order
            x = x * (self.longest / np.sqrt((x * x).sum(axis=1, keepdims=True)))
        return np.concatenate([x, rest[:, None]], axis=1)

    def cell(self, lifted: np.ndarray) -> np.ndarray:
        at = (np.einsum("nd,tdk->tnk", lifted, self.a) + self.b[:, None]) / self.w[:, None]
        return np.clip(np.floor(at), 0, CELLS - 1).astype(np.int8)

    def costs(self, queries: np.ndarray) -> np.ndarray:
        """(tables, queries, depth, cells): squared distance to each cell, in the function's own units."""
        at = np.einsum("nd,tdk->tnk", self.lift(queries, True), self.a) + self.b[:, None]
        cells = np.arange(CELLS)
        low = np.where(cells == 0, -np.inf, cells) * self.w[:, None, :, None]
        high = np.where(cells == CELLS - 1, np.inf, cells + 1) * self.w[:, None, :, None]
        gap = np.maximum(0, np.maximum(low - at[..., None], at[..., None] - high))
        return (gap * gap).astype(np.float32)

    @staticmethod
    def estimate(cost: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """(queries, n): the sum of costs (queries, depth, cells) for each row of cells (n, depth)."""
        hot = (cell[:, :, None] == np.arange(CELLS)).astype(np.float32)
        return cost.reshape(len(cost), -1) @ hot.reshape(len(cell), -1).T

    def limits(self, cost: np.ndarray, share: float) -> np.ndarray:
        """(tables, queries): the estimate up to which buckets hold this share of the sample."""
        out = []
        for t in range(TABLES):
            e = self.estimate(cost[t], self.cells[t])
            k = min(e.shape[1] - 1, math.ceil(share * e.shape[1]))
            out.append(np.partition(e, k, axis=1)[:, k])
        return np.stack(out)

    def fit(self, sample: np.ndarray, queries: np.ndarray, top: int) -> float:
        """The least share of a few that finds TARGET of the sample's true neighbours of its queries."""
        if len(sample) <= top or not len(queries):
            return 1.0
        product = queries.astype(np.float64) @ sample.astype(np.float64).T
        product[(queries[:, None, :1] == sample[None, :, :1])[..., 0] & (product > 0)
                & np.isclose(product, (queries**2).sum(axis=1)[:, None])] = -np.inf  # itself
        best = np.argpartition(-product, top, axis=1)[:, :top]
        cost = self.costs(queries)
        for share in (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6, 0.7, 0.8):
            limit = self.limits(cost, share)
            found = np.zeros(best.shape, bool)
            for t in range(TABLES):
                e = self.estimate(cost[t], self.cells[t])
                found |= np.take_along_axis(e, best, 1) <= limit[t][:, None]
            if found.mean() >= TARGET:
                return share
        return 1.0


def _blocks(cell: np.ndarray, front: int) -> np.ndarray:
    return cell[..., :front].astype(np.int64) @ (CELLS ** np.arange(front))


def search(vectors: DataFrame, top: int = 20, every: int = 20, vec_id: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of each row whose id is divisible by ``every`` the nearest found."""
    x = F.col("x")
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")) \
        .where("id is not null and size(x) > 0") \
        .where(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))) \
        .where(F.exists(x, lambda v: v != 0)).distinct()
    rows = written(rows, "vectors")
    sizes = rows.groupBy(F.size("x").alias("dim")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))).alias("longest")).collect()
    found = [_search_dim(rows.where(F.size("x") == r["dim"]), r["n"], r["longest"], top, every)
             for r in sorted(sizes, key=lambda r: r["dim"])]
    if not found:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _search_dim(rows: DataFrame, count: int, longest: float, top: int, every: int) -> DataFrame:
    """search among vectors of one length (each length is an index of its own)."""
    spark = rows.sparkSession
    asked = rows.where(F.col("id") % every == 0)
    pick = lambda df, n: np.array([r[0] for r in df.orderBy(F.xxhash64("id"), "id").limit(n).select("x").collect()])
    queries = pick(asked, TRIALS)
    if not len(queries):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = Index(pick(rows, SAMPLE), queries, longest, count, top)
    shared = spark.sparkContext.broadcast(index)

    # a block of many rows is dealt out by id; as many blocks as cells of the front functions
    def blocks(batches):
        for batch in batches:
            own = _blocks(shared.value.cell(shared.value.lift(_matrix(batch.column("x")))), shared.value.front)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(TABLES), batch.num_rows).astype(np.int32)), pa.array(own.ravel()),
                 pa.concat_arrays([batch.column("id")] * TABLES), pa.concat_arrays([batch.column("x")] * TABLES)],
                ["t", "block", "id", "x"])

    indexed = rows.select("id", "x").mapInArrow(blocks, "t int, block long, id long, x array<double>")
    pieces = {(r["t"], r["block"]): max(1, round(r["n"] / PIECE)) for r in
              indexed.groupBy("t", "block").agg(F.count(F.lit(1)).alias("n")).collect()}
    split = spark.sparkContext.broadcast(pieces)

    def probes(batches):
        index_, pieces_ = shared.value, split.value
        names = sorted(pieces_)
        front = index_.front
        for batch in batches:
            q = _matrix(batch.column("x"))
            if not len(q):
                continue
            cost = index_.costs(q)
            limit = index_.limits(cost, index_.share)
            out: list[list] = [[], [], [], []]
            for t, block in names:
                digits = (block // CELLS ** np.arange(front)) % CELLS
                least = sum(cost[t][:, k, d] for k, d in enumerate(digits))
                mine = np.flatnonzero(least <= limit[t])
                for piece in range(pieces_[t, block]):
                    out[0].append(np.full(len(mine), t, np.int32))
                    out[1].append(np.full(len(mine), block * (1 << 20) + piece))
                    out[2].append(mine)
                    out[3].append(limit[t][mine])
            row = np.concatenate(out[2])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out[0])), pa.array(np.concatenate(out[1]), pa.int64()),
                 batch.column("id").take(pa.array(row)), batch.column("x").take(pa.array(row)),
                 pa.array(np.concatenate(out[3]).astype(np.float64))], ["t", "piece", "id", "x", "limit"])

    sent = asked.select("id", "x").mapInArrow(probes, "t int, piece long, id long, x array<double>, limit double")

    def deal(batches):
        pieces_ = split.value
        for batch in batches:
            t, block, ids = (batch.column(c).to_numpy() for c in ("t", "block", "id"))
            n = np.array([pieces_[a, b] for a, b in zip(t.tolist(), block.tolist(), strict=True)], np.int64)
            piece = block * (1 << 20) + (((ids * 40503) >> 3) % 1000003) % n if len(n) else block
            yield pa.RecordBatch.from_arrays([batch.column("t"), pa.array(piece, pa.int64()), batch.column("id"),
                                              batch.column("x")], ["t", "piece", "id", "x"])

    dealt = indexed.mapInArrow(deal, "t int, piece long, id long, x array<double>")

    def rank(key, have: pa.Table, ask: pa.Table) -> pa.Table:
        t, index_ = key[0].as_py(), shared.value
        ids, x = have.column("id").to_numpy(), _matrix(have.column("x"))
        qid, q, limit = ask.column("id").to_numpy(), _matrix(ask.column("x")), ask.column("limit").to_numpy()
        out: list[list] = [[], [], []]
        if len(ids) and len(qid):
            out = _rank(index_, t, ids, x, qid, q, limit, top)
        return pa.table([pa.array(np.concatenate([np.zeros(0, np.int64), *out[0]])),
                         pa.array(np.concatenate([np.zeros(0, np.int64), *out[1]])),
                         pa.array(np.concatenate([np.zeros(0), *out[2]]))], ["query_id", "vec_id", "score"])

    hits = dealt.groupBy("t", "piece").cogroup(sent.groupBy("t", "piece")) \
        .applyInArrow(rank, "query_id long, vec_id long, score double")
    merged = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return merged.withColumn("rank", place).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def _rank(index: Index, t: int, ids, x, qid, q, limit, top: int) -> list[list]:
    """Of each query its nearest in the buckets that it visits of this piece, ties to smaller ids."""
    order = np.lexsort((ids, *x.T[::-1]))
    ids, x = ids[order], x[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)])
    group = np.cumsum(new) - 1
    nth = np.arange(len(ids)) - np.flatnonzero(new)[group]
    few = nth <= top  # of equal vectors the smallest ids; one more, as a query doesn't find itself
    ids, x = ids[few], x[few]
    lifted = index.lift(x)
    cells = index.cell(lifted)[t]
    bucket, of = np.unique(cells, axis=0, return_inverse=True)
    cost = index.costs(q)[t]
    out: list[list] = [[], [], []]
    single = x.astype(np.float32)
    for at in range(0, len(qid), QUERIES):
        some = slice(at, at + QUERIES)
        visit = index.estimate(cost[some], bucket) <= limit[some, None] + 1e-6
        score = np.where(visit[:, of.ravel()], q[some].astype(np.float32) @ single.T, -np.inf)
        score[ids[None] == qid[some, None]] = -np.inf
        k = min(top, score.shape[1])
        # what might be among the nearest after rounding, with all ties
        edge = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        size = np.abs(q[some]).sum(axis=1) * np.abs(x).max()
        for i in range(len(score)):
            near = np.flatnonzero((score[i] >= edge[i] - 1e-5 * size[i]) & (score[i] > -np.inf))
            if not len(near):
                continue
            exact = (x[near] * q[at + i]).sum(axis=1)
            best = near[np.lexsort((ids[near], -exact))][:top]
            out[0].append(np.full(len(best), qid[at + i]))
            out[1].append(ids[best])
            out[2].append((x[best] * q[at + i]).sum(axis=1))
    return out
