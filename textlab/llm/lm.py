"""Language-model scoring with stupid backoff over corpus counts (operator 9).

A text is the words w1 ... wn between a start and an end mark. Each word and
the end mark is scored given the word before it:

    S(w | v) = c(v w) / c(v)          if c(v w) is at least LEAST,
               BACKOFF * c(w) / N     otherwise,

with counts over all documents; a pair that the corpus has once only was seen
here only, so it is no evidence. The score is the mean of ln S.

Count tables are partitioned by hash. The pairs of a block of documents go, in
packed arrays, to the partition of their first word, which so holds all counts
of that word and its pairs; it adds up what the pairs found give each document
and sends the others on to the partition of their second word, where they are
joined to its count. Both add up by document before they send sums back.

Hot keys don't gather: words with over 1/HOT of all tokens (fewer than HOT,
broadcast with their counts) have their pairs dealt out by both words, and
are known wherever they are the second word. Pairs that a bounded sample shows
to be frequent are counted over all documents in the first pass (at most
2*HOT), and are scored where they are read. The sample decides on the way only.

Words are runs without white space, A-Z lower-cased, known by 48 bits of a hash.

Cases: a null, empty or blank text has no words and a null score. Rows are
never matched by id, so null and repeated ids are kept, each row with its
score. No rows give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.llm.common import utf8_slices, written

LEAST, BACKOFF = 2, 0.4
HOT, SAMPLE = 20_000, 8_000
#: Bytes of text in a block; tokens in a partition; bytes hashed at a time.
BLOCK, PART, CHUNK = 8 << 20, 2_000_000, 1 << 20
START, END = 1, 2
_BASE = 0x9E3779B97F4A7C15 | 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hash and first byte of each word of some bytes, CHUNK or so at a time."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    gaps = np.flatnonzero(space)
    hashes, begins, at = [], [], 0
    while at < len(data):
        end = len(data)
        if at + CHUNK < end:
            k = np.searchsorted(gaps, at + CHUNK)
            end = int(gaps[k]) if k < len(gaps) else end
        real = ~space[at:end]
        edge = np.diff(np.concatenate([[0], real.astype(np.int8), [0]]))
        a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        up, down = _powers(end - at)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(
            (_LOWER[data[at:end]].astype(np.uint64) + np.uint64(1)) * up[:end - at], dtype=np.uint64)])
        hashes.append(mix((total[b] - total[a]) * down[a]) >> np.uint64(16))
        begins.append(a + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.concatenate(hashes)
    return np.where(h <= END, h + np.uint64(3), h), np.concatenate(begins)


def pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * np.uint64(_BASE) + w)


def blocks(batch: pa.RecordBatch):
    """(first row, end, words v and w of each pair, row in the block) for the blocks of a batch of texts."""
    data, at = utf8_slices(batch.column("text"))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(at, at[row] + BLOCK, "right")) - 1)
        end = min(end, row + 60_000, batch.num_rows)
        # a space between texts, so that no word goes on from one to the next
        part = np.insert(data[at[row]:at[end]], at[row + 1:end] - at[row], 32)
        h, begin = words(part)
        doc = np.searchsorted(at[row + 1:end] - at[row] + np.arange(end - row - 1), begin, "right")
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]])) if len(doc) else np.zeros(0, int)
        last = np.append(first[1:], len(doc))
        v = np.insert(h, first, START)
        w = np.insert(h, last[:len(first)], END)
        yield row, end, v, w, np.insert(doc, first, doc[first])
        row = end


def _find(keys: np.ndarray, counts: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Counts of x among sorted keys; 0 where it isn't there."""
    if not len(keys):
        return np.zeros(len(x), np.int64)
    i = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[i] == x, counts[i], 0)


def _pack(x: np.ndarray) -> bytes:
    """48-bit numbers, six bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def counts(texts: DataFrame, pairs: np.ndarray | None) -> DataFrame:
    """(is_pair, hash, n) of all words, and of the given pairs (None: of all, and of no word)."""
    shared = texts.sparkSession.sparkContext.broadcast(pairs)

    def run(batches):
        wanted = shared.value
        for batch in batches:
            for _, _, v, w, _ in blocks(batch):
                p = pair(v, w)
                words_, n = np.unique(w if wanted is not None else w[:0], return_counts=True)
                found, m = np.unique(p if wanted is None else p[_find(wanted, np.ones(len(wanted), int), p) > 0],
                                     return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([False, True], [len(n), len(m)])),
                     pa.array(np.concatenate([words_, found]).view(np.int64)), pa.array(np.concatenate([n, m]))],
                    ["is_pair", "hash", "n"])

    return texts.mapInArrow(run, "is_pair boolean, hash long, n long") \
        .groupBy("is_pair", "hash").agg(F.sum("n").alias("n"))


#: What goes between the steps. kind 0: pairs; 1: documents of a block (ids, words, sums); 2: sums.
SCHEMA = "bucket long, kind int, block long, keys binary, sizes binary, second binary, docs binary, " \
         "sums binary, ids array<long>"
FIELDS = ["bucket", "kind", "block", "keys", "sizes", "second", "docs", "sums", "ids"]


def _rows(rows: list[tuple]) -> pa.Table:
    types = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5, pa.list_(pa.int64())]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(FIELDS)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], FIELDS)


def _runs(bucket: np.ndarray, key: np.ndarray, *rest: np.ndarray):
    """(bucket, keys, run lengths, the rest) for each bucket, sorted by key."""
    order = np.lexsort((key, bucket))
    bucket, key, rest = bucket[order], key[order], [r[order] for r in rest]
    begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
    for a, b in zip(begin, np.append(begin[1:], len(bucket)) if len(bucket) else [], strict=True):
        own = key[a:b]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        yield int(bucket[a]), own[first], np.diff(np.append(first, b - a)), [r[a:b] for r in rest]


class Counts:
    """What every task knows: the hot words and pairs, and the number of tokens."""

    def __init__(self, hot: list, pairs: list, total: int, part: int):
        self.total, self.parts = total, max(1, total // part)
        self.hot, self.hot_n = (np.array(x, np.int64) for x in (zip(*sorted(hot), strict=True) if hot else ((), ())))
        self.hot = self.hot.view(np.uint64)
        own = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        order = np.argsort(own[:, 0].view(np.uint64))
        self.pairs, self.pairs_n = own[order, 0].copy().view(np.uint64), own[order, 1]

    def backoff(self, n: np.ndarray) -> np.ndarray:
        return np.log(BACKOFF) + np.log(n) - np.log(self.total)


def _read(known: Counts, texts: DataFrame) -> DataFrame:
    """Blocks of documents: pairs for each partition, and a row with the documents."""
    shared = texts.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        from pyspark import TaskContext

        c, number = shared.value, TaskContext.get().partitionId() << 32
        parts = np.uint64(c.parts)
        for batch in batches:
            for row, end, v, w, doc in blocks(batch):
                number += 1
                hot_v = _find(c.hot, c.hot_n, v)
                both = np.where(hot_v > 0, _find(c.pairs, c.pairs_n, pair(v, w)), 0)
                here = both >= LEAST
                sums = np.bincount(doc[here], np.log(both[here]) - np.log(hot_v[here]), end - row)
                n = np.maximum(0, np.bincount(doc, minlength=end - row) - 1)
                out = [(number % c.parts, 1, number, None, None, n.astype("<i8").tobytes(), None,
                        sums.astype("<f8").tobytes(), batch.column("id").slice(row, end - row).to_pylist())]
                v, w, doc, hot_v = v[~here], w[~here], doc[~here], hot_v[~here]
                bucket = np.where(hot_v > 0, pair(v, w) % parts, v % parts).astype(np.int64)
                for b, keys, size, (second, docs) in _runs(bucket, v, w, doc):
                    out.append((b, 0, number, _pack(keys), size.astype("<u4").tobytes(), _pack(second),
                                docs.astype("<u2").tobytes(), None, None))
                yield from _rows(out).to_batches()

    return texts.mapInArrow(run, SCHEMA)


def _entries(table: pa.Table) -> tuple[list[np.ndarray], list[tuple]]:
    """Keys, second words, blocks and documents of all pairs; and the other rows, as they are."""
    got = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    other = []
    for r in table.to_pylist():
        if r["kind"]:
            other.append(tuple(r[f] for f in FIELDS))
            continue
        size = np.frombuffer(r["sizes"], "<u4")
        docs = np.frombuffer(r["docs"], "<u2")
        got[0].append(np.repeat(_unpack(r["keys"]), size))
        got[1].append(_unpack(r["second"]) if r["second"] else np.zeros(0, np.uint64))
        got[2].append(np.frombuffer(r["sums"], "<i8") if r["sums"] else np.full(len(docs), r["block"]))
        got[3].append(docs.astype(np.int64))
    return [np.concatenate(x) for x in got], other


def _sums(parts: int, block: np.ndarray, doc: np.ndarray, value: np.ndarray) -> list[tuple]:
    """Rows of kind 2: for each block the sums by document."""
    order = np.lexsort((doc, block))
    block, doc, value = block[order], doc[order], value[order]
    if not len(block):
        return []
    new = np.concatenate([[True], (block[1:] != block[:-1]) | (doc[1:] != doc[:-1])])
    at = np.flatnonzero(new)
    total, block, doc = np.add.reduceat(value, at), block[at], doc[at]
    cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
    return [(int(block[a]) % parts, 2, int(block[a]), None, None, None, doc[a:b].astype("<u2").tobytes(),
             total[a:b].astype("<f8").tobytes(), None) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _pairs(known: Counts, spark):
    """Of a partition of first words: sums of the pairs found; the others by their second word."""
    shared = spark.sparkContext.broadcast(known)

    def run(table: pa.Table) -> pa.Table:
        c = shared.value
        (v, w, block, doc), out = _entries(table)
        if len(v):
            _, of, n = np.unique(pair(v, w), return_inverse=True, return_counts=True)
            both = n[of]
            _, of, n = np.unique(v, return_inverse=True, return_counts=True)
            hot = _find(c.hot, c.hot_n, v)
            first = np.where(hot > 0, hot, n[of])
            hot_w = _find(c.hot, c.hot_n, w)
            value = np.where(both >= LEAST, np.log(both) - np.log(first), c.backoff(np.maximum(1, hot_w)))
            here = (both >= LEAST) | (hot_w > 0)
            out += _sums(c.parts, block[here], doc[here], value[here])
            w, block, doc = w[~here], block[~here], doc[~here]
            for b, keys, size, (blocks_, docs) in _runs((w % np.uint64(c.parts)).astype(np.int64), w, block, doc):
                out.append((b, 0, 0, _pack(keys), size.astype("<u4").tobytes(), None, docs.astype("<u2").tobytes(),
                            blocks_.astype("<i8").tobytes(), None))
        return _rows(out)

    return run


def _singles(known: Counts, spark):
    """Of a partition of second words: sums of the pairs that were not found."""
    shared = spark.sparkContext.broadcast(known)

    def run(table: pa.Table, counted: pa.Table) -> pa.Table:
        c = shared.value
        (w, _, block, doc), out = _entries(table)
        key, n = counted.column("hash").to_numpy().view(np.uint64), counted.column("n").to_numpy()
        order = np.argsort(key)
        value = c.backoff(_find(key[order], n[order], w))
        return _rows(out + _sums(c.parts, block, doc, value))

    return run


def _documents(table: pa.Table) -> pa.Table:
    """Of a block: a row for each document."""
    rows = table.to_pylist()
    head = next(r for r in rows if r["kind"] == 1)
    n = np.frombuffer(head["second"], "<i8")
    total = np.frombuffer(head["sums"], "<f8").copy()
    # in a fixed order, so that reruns add alike
    for r in sorted((r for r in rows if r["kind"] == 2), key=lambda r: (r["docs"], r["sums"])):
        total[np.frombuffer(r["docs"], "<u2")] += np.frombuffer(r["sums"], "<f8")
    none = n == 0
    return pa.table([pa.array(head["ids"], pa.int64()), pa.array(n), pa.array(total, mask=none),
                     pa.array(total / (n + 1), mask=none)], ["id", "n_words", "log_prob", "score"])


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot_part: int = HOT,
          part: int = PART) -> DataFrame:
    """A row for each document: id, n_words, log_prob (the sum) and score (its mean by word and end mark)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    every = max(1, docs.count() // SAMPLE)
    sample = counts(texts.where(F.pmod(F.xxhash64("id", "text"), F.lit(every)) == 0), None)
    seen = sample.orderBy(F.col("n").desc(), "hash").limit(2 * hot_part).select("hash")
    frequent = np.sort(np.array([r[0] for r in seen.collect()], np.int64).view(np.uint64))
    counted = written(counts(texts, frequent), "counts")
    single = counted.where("not is_pair").select("hash", "n")
    total = single.agg(F.sum("n")).first()[0] or 0
    share = total // hot_part
    hot = [tuple(r) for r in single.where(F.col("n") > share).collect()]
    starts = [n for h, n in hot if h == END] or [r[0] for r in single.where(F.col("hash") == END).select("n").collect()]
    hot += [(START, n) for n in starts]  # as many start marks as end marks
    if starts and END not in [h for h, _ in hot]:
        hot.append((END, starts[0]))
    pairs = [tuple(r) for r in counted.where("is_pair").select("hash", "n").where(F.col("n") > share // 2).collect()]
    known = Counts(hot, pairs, total, part)
    first = _read(known, texts).groupBy("bucket").applyInArrow(_pairs(known, spark), SCHEMA)
    tables = single.withColumn("bucket", F.pmod("hash", F.lit(known.parts)))
    second = first.groupBy("bucket").cogroup(tables.groupBy("bucket")).applyInArrow(_singles(known, spark), SCHEMA)
    return second.groupBy("block").applyInArrow(_documents, "id long, n_words long, log_prob double, score double") \
        .withColumnRenamed("id", doc_id)
