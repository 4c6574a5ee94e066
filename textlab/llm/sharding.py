"""Sharding by Karmarkar-Karp differencing (operator 5).

The law is ``bytes``: shard sizes are near equal, and rows of equal text go to
one shard. A partial partition is a tuple of shard sums; differencing combines
the two of largest spread, one in opposite order to the other, until one is
left. It runs on three kinds of items:

* heavy groups, with over 1/HEAVY of a shard's bytes: under shards * HEAVY of them;
* a bounded random share of the other groups (``fine`` in all), which fill
  what the large items leave uneven;
* the parts into which differencing has split each bucket of the other groups,
  a task a bucket. Buckets grow in number with the groups, so a task's work
  stays the same; while there are more parts than ``fine``, they are bucketed
  and split again the same way.

Heavy groups, fine groups and parts meet in one task, whose input these bounds
keep small at any size. Text is hashed where it is read and never shuffled.

Cases: a null text has size 1 and counts as equal to the empty text. Repeated
rows share a shard. A shard that gets no group has no rows. If one group holds
more than a shard's fair share, its shard is as large as the group and the
others share the rest. No rows give no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.common import cut_lineage, in_order, lookup, written

#: A group is heavy from this part of a fair shard on.
HEAVY = 1000
#: Groups and parts that meet in one task at the end, besides the heavy groups.
FINE = 20_000
#: Groups that a bucket has on average.
BUCKET = 20_000


def difference(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item, by k-way differencing."""
    n = len(sizes)
    if not n:
        return np.zeros(0, np.int64)
    zero = (0,) * (shards - 1)
    sums: dict[int, tuple] = {i: (int(s), *zero) for i, s in enumerate(sizes)}  # in falling order, least 0
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    made: list[tuple[int, int, tuple]] = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        merged = list(map(int.__add__, sums.pop(a), reversed(sums.pop(b))))
        order = sorted(range(shards), key=merged.__getitem__, reverse=True)
        least = merged[order[-1]]
        node = n + len(made)
        sums[node] = tuple(merged[j] - least for j in order)
        made.append((a, b, tuple(order)))
        heapq.heappush(heap, (-sums[node][0], node))
    # from the last partition down: place[node][j] is the shard of the node's j-th sum
    place = {heap[0][1]: tuple(range(shards))}
    out = np.zeros(n, np.int64)
    if n == 1:
        return out
    for k in range(len(made) - 1, -1, -1):
        a, b, order = made[k]
        mine = place.pop(n + k)
        at = [0] * shards
        for j, slot in enumerate(order):
            at[slot] = mine[j]
        for child, where in ((a, at), (b, at[::-1])):
            if child < n:
                out[child] = where[0]
            else:
                place[child] = where
    return out


def _bucketed(items: DataFrame, buckets: int, shards: int) -> DataFrame:
    """items (key, size) with bucket and part: the shard of each in its bucket's own partition."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["size", "key"], ascending=[False, True])
        return f.assign(part=difference(f["size"].to_numpy(), shards))

    dealt = items.select(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"), "key", F.col("size").cast("long"))
    return dealt.groupBy("bucket").applyInPandas(run, "bucket long, key string, size long, part long")


def assign(groups: DataFrame, shards: int, fine: int = FINE, bucket: int = BUCKET) -> DataFrame:
    """(key, n, shard) of the groups (key, size, n): n is the number of rows, carried along."""
    count, whole = groups.agg(F.count(F.lit(1)), F.sum("size")).first()
    if not count:
        return groups.select("key", "n", F.lit(0).alias("shard"))
    # of the rest, about fine groups stay single, chosen by hash; all of them, if they are few
    single = (F.col("size") > whole / (shards * HEAVY)) \
        | (F.pmod(F.xxhash64("key", F.lit(7)), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, fine / count))))
    marked = groups.withColumn("single", single)
    top = marked.where("single").select("key", "size")
    rest = marked.where("not single").select("key", "size")
    levels = []
    while (left := rest.count()) > 0:
        parted = cut_lineage(_bucketed(rest, max(1, left // bucket), shards)
                             .withColumn("up", F.concat_ws(":", F.lit(len(levels)), "bucket", "part")))
        levels.append(parted.select("key", "up"))
        rest = cut_lineage(parted.groupBy(F.col("up").alias("key")).agg(F.sum("size").alias("size")))
        if left // bucket * shards <= fine:
            top = top.union(rest)
            break
    final = cut_lineage(_bucketed(top, 1, shards).select("key", F.col("part").cast("int").alias("shard")))
    for down in reversed(levels):  # a part's shard is that of its members
        members = down.join(final.select(F.col("key").alias("up"), "shard"), "up").select("key", "shard")
        final = final.union(members)
    return groups.join(final, "key").select("key", "n", "shard")


def shard(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: id, size, text_crc32, shard, and slot, its place there by id from 0."""
    content = F.coalesce(F.col(text), F.lit(""))
    rows = written(docs.select(
        doc_id, (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(F.encode(content, "UTF-8")).cast("long").alias("text_crc32"),
        F.concat(F.md5(content), F.octet_length(content).cast("string")).alias("key")), "sizes")
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "groups")
    placed = written(assign(groups, shards), "shards")
    total = placed.agg(F.sum("n")).first()[0] or 0
    dealt = lookup(rows, placed, "key", "n", F.concat(F.lit("#"), F.monotonically_increasing_id()), total)
    ordered = in_order(dealt.drop("key"), [F.col("shard"), F.col(doc_id), F.col("text_crc32"), F.col("size")], "at")
    first = ordered.groupBy("shard").agg(F.min("at").alias("first"))  # as many rows as shards
    return ordered.join(F.broadcast(first), "shard") \
        .select(doc_id, "size", "text_crc32", "shard", (F.col("at") - F.col("first")).alias("slot"))
