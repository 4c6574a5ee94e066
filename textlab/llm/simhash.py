"""SimHash near-duplicates by segment popcounts (operator 10).

Fingerprints are embedded by the number of ones in each 2-bit segment. That
number changes by at most the bits that differ, so the Manhattan distance of
two embeddings is a lower bound of the Hamming distance. The embedding is kept
in one long in thermometer code (00, 01, 11 for 0, 1, 2 ones), where Manhattan
distance is the number of differing bits. Its grid: the 32 counts form GROUPS
groups; two embeddings within Manhattan distance d agree in at least GROUPS-d
groups, so they share the grid cell of some choice of that many groups. Rows of
a cell are compared by Manhattan distance, then exactly by Hamming distance.

Equal fingerprints are first collapsed, with counts before the shuffle, so a
group of copies of any size is one row; in a crowded cell, links are found by a
search that compares a fingerprint only with those not reached so far, and each
fingerprint reached is linked to the first one, so a group of near copies gives
as many links as it has members and no pairs are lost to the components.

Cases: a null or empty text, or one of white space, has no shingle and the
fingerprint zero, which links like any other; a text with fewer words than a
shingle is one shingle. Rows with a null id take part; a component of which no
row has an id has a null component. Repeated rows are copies of one another.
No rows give no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.llm.common import add_columns, components, fresh, lookup, tidy, written

#: Groups of segments; a choice of GROUPS - max_bits of them makes a cell.
GROUPS = 8
SEED = 42
#: Shingle hashes whose bits are counted at a time.
CHUNK = 1 << 16
#: Cells with more fingerprints are searched instead of compared pair by pair.
CROWD = 32
_LOW = 0x5555555555555555


def fingerprint(text: str, shingle: int) -> int:
    """Unsigned 64-bit SimHash over all word shingles of a text, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in
                       zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[at:at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4, name: str = "fingerprint",
                 drop_text: bool = False) -> DataFrame:
    """docs with the 64-bit fingerprint of its text as a (signed) long."""
    def make():
        def work(column):
            return [pa.array(np.array([fingerprint(t, shingle) for t in column.fill_null("").to_pylist()],
                                      np.uint64).view(np.int64))]
        return work

    return add_columns(docs, [text], [T.StructField(name, T.LongType())], make, [text] if drop_text else [])


def thermometer(fp: Column) -> Column:
    """Counts of ones of the 2-bit segments, each in thermometer code."""
    next_ = F.shiftrightunsigned(fp, 1)
    low = F.lit(_LOW)
    return fp.bitwiseOR(next_).bitwiseAND(low).bitwiseOR(
        F.shiftleft(fp.bitwiseAND(next_).bitwiseAND(low), 1))


def masks(max_bits: int) -> list[int]:
    """For each choice of GROUPS - max_bits groups of segments, its bits, as signed longs."""
    if not 0 <= max_bits < GROUPS:
        raise ValueError(f"max_bits must be from 0 to {GROUPS - 1}")
    width = 64 // GROUPS
    group = [((1 << width) - 1) << (width * g) for g in range(GROUPS)]
    return [int(np.array(sum(c), np.uint64).view(np.int64)) for c in combinations(group, GROUPS - max_bits)]


def _thermometer(fp: np.ndarray) -> np.ndarray:
    low, one = np.uint64(_LOW), np.uint64(1)
    return ((fp | (fp >> one)) & low) | (((fp & (fp >> one)) & low) << one)


def near(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Which pairs are within max_bits: by Manhattan distance of the counts first, then exactly."""
    ok = np.bitwise_count(_thermometer(a) ^ _thermometer(b)) <= max_bits
    ok[ok] = np.bitwise_count((a ^ b)[ok]) <= max_bits
    return ok


def search(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, other) for each fingerprint reached from another of the cell."""
    first, other, left = [], [], fps
    while len(left) > 1:
        seed, left, queue = left[0], left[1:], [left[0]]
        while queue and len(left):
            x = queue.pop()
            hit = near(np.broadcast_to(x, left.shape), left, max_bits)
            if hit.any():
                found = left[hit]
                left = left[~hit]
                queue += list(found)
                first.append(np.full(len(found), seed))
                other.append(found)
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *first]), np.concatenate([empty, *other])


def cell_links(cell: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within each run of equal cells; cells are sorted."""
    begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, int)
    size = np.diff(np.append(begin, len(cell)))
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for n in range(2, CROWD + 1):
        rows = fps[begin[size == n][:, None] + np.arange(n)]
        for i, j in combinations(range(n), 2) if len(rows) else ():
            ok = near(rows[:, i], rows[:, j], max_bits)
            a.append(rows[ok, i])
            b.append(rows[ok, j])
    for i in np.flatnonzero(size > CROWD):
        x, y = search(fps[begin[i]:begin[i] + size[i]], max_bits)
        a.append(x)
        b.append(y)
    both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
    return both[:, 0], both[:, 1]


def links(distinct: DataFrame, max_bits: int, name: str = "fingerprint") -> DataFrame:
    """Links (a, b) whose components are those of all pairs within max_bits."""
    fp = F.col(name)
    cells = distinct.select(fp.alias("fp"), thermometer(fp).alias("code")).select(
        "fp", "code", F.posexplode(F.array(*[F.lit(m) for m in masks(max_bits)])).alias("choice", "mask")) \
        .select(F.col("choice").cast("byte").alias("choice"), F.col("code").bitwiseAND(F.col("mask")).alias("cell"), "fp")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.repartition(n, "choice", "cell").sortWithinPartitions("choice", "cell")

    def run(batches):
        def out(choice, cell, fps):
            key = np.stack([choice.astype(np.uint64), cell], axis=1)
            change = (key[1:] != key[:-1]).any(axis=1)
            a, b = cell_links(np.concatenate([[0], np.cumsum(change)]) if len(cell) else cell, fps, max_bits)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        held: list = []  # the last cell may go on in the next batch
        for batch in batches:
            new = [batch.column(0).to_numpy().astype(np.int64),
                   *[batch.column(i).to_numpy().view(np.uint64) for i in (1, 2)]]
            if not len(new[0]):
                continue
            if held and held[-1][0][-1] == new[0][-1] and held[-1][1][-1] == new[1][-1]:
                held.append(new)
                continue
            held.append(new)
            choice, cell, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            last = np.flatnonzero((choice != choice[-1]) | (cell != cell[-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield out(choice[:cut], cell[:cut], fps[:cut])
            held = [[choice[cut:], cell[cut:], fps[cut:]]]
        if held:
            yield out(*(np.concatenate(x) for x in zip(*held, strict=True)))
        tidy()

    return dealt.mapInArrow(run, "a long, b long")


def classes(rows: DataFrame, max_bits: int = 4, name: str = "fingerprint", doc_id: str = "doc_id") -> DataFrame:
    """rows (written ones) with ``component_id``: the smallest id that links lead to, and ``root``: the
    smallest fingerprint of the component, which tells components of one smallest id apart.

    Rows of one fingerprint are collapsed, so the links and components are
    found between distinct fingerprints.
    """
    distinct = written(rows.groupBy(name).agg(F.min(doc_id).alias("low"), F.count(F.lit(1)).alias("n")), "fingerprints")
    reached = components(links(distinct, max_bits, name)).withColumnRenamed("node", name)
    rooted = written(distinct.join(reached, name, "left")
                     .withColumn("root", F.coalesce("root", name)), "rooted")
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("m"))
    total = distinct.agg(F.sum("n"), F.count(F.lit(1))).first()
    known = written(lookup(rooted.select(name, "n", "root"), least, "root", "m", F.xxhash64(name), total[1])
                    .select(name, "n", "component_id", "root"), "classes")
    return lookup(rows, known, name, "n", F.xxhash64(F.monotonically_increasing_id()), total[0] or 0)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4,
                    max_bits: int = 4) -> DataFrame:
    """A row for each document: its id, fingerprint and component_id."""
    rows = fingerprints(docs.select(doc_id, text), text, shingle, drop_text=True)
    return classes(written(rows, "simhash"), max_bits, doc_id=doc_id).drop("root")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4,
             max_bits: int = 4) -> DataFrame:
    """docs with one row of each component: that of its smallest id (null last), of equal ids the
    one whose text has the smallest hash, of repeated rows one."""
    hashed = docs.select(doc_id, text).withColumn("__text", F.xxhash64(text))
    rows = written(fingerprints(hashed, text, shingle, drop_text=True), "simhash")
    found = classes(rows, max_bits, doc_id=doc_id)
    first = F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col("__text").alias("hash")))
    kept = found.groupBy("root").agg(first.alias("first")).select(
        F.col("first.id").alias("__id"), F.col("first.hash").alias("__text"))
    own = fresh(docs, "__text")
    mine = docs.withColumn(own, F.xxhash64(text))
    return mine.join(kept, mine[doc_id].eqNullSafe(kept["__id"]) & (mine[own] == kept["__text"]), "left_semi") \
        .dropDuplicates([doc_id, own]).drop(own)
