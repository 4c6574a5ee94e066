"""Phrases of a table found in the sentences of another (N1, lookup).

What is written and exchanged grows with the words and with what is found, not
with words times lengths of phrases: a sentence's words are put together where they
already follow each other, and a run of words is sent to the table of phrases
only if a filter of their hashes, small enough to be shipped, may hold it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.operators.common import BROADCAST_BYTES_LIMIT, broadcast_measured, cut_lineage, written

# Sentences of a text that are exchanged together when its words don't lie in one place.
BLOCK_SENTENCES = 64
# The filter: bits a phrase, chunks of so many bits, and at most so many chunks (128 MB).
ENTRY_BITS, CHUNK_BITS, MAX_CHUNKS = 16, 1 << 19, 2048
# From this many words on, a run that no phrase begins like is given up at each power of two.
LONG = 16

_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(ord, sent_id, block, word_id, text)`` to a row for each stretch of rows with one sentence's words in order.

    A piece is a stretch of a block's sentences in order; each sentence is in it once.
    """
    piece, held = TaskContext.get().partitionId() << 33, None

    def grouped(cols, new, ids, upto):
        starts = np.flatnonzero(new)[:upto]
        ends = np.append(np.flatnonzero(new), len(new))[:len(starts) + 1].astype(np.int32)
        first, lists = pa.array(starts), pa.array(ends)
        last = int(ends[-1])
        return pa.RecordBatch.from_arrays(
            [*[c.take(first) for c in cols[:3]], pa.array(ids[starts]),
             *[pa.ListArray.from_arrays(lists, c.slice(0, last)) for c in cols[3:]]],
            ["ord", "sent_id", "block", "piece", "word_ids", "words"])

    for part in batches:
        cols = part.columns if held is None else [pa.concat_arrays(x) for x in zip(held, part.columns)]
        n = len(cols[0])
        if not n:
            continue
        told = lambda test, c: pc.fill_null(test(c.slice(1), c.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
        beside = told(pc.equal, cols[0]) & told(pc.equal, cols[2])
        goes_on = beside & told(pc.equal, cols[1]) & told(pc.greater, cols[3])
        new = np.concatenate([[True], ~goes_on])
        turns = np.concatenate([[held is None], ~(goes_on | beside & told(pc.greater, cols[1]))])
        ids = piece + np.cumsum(turns)
        tail = int(np.flatnonzero(new)[-1])
        if tail:
            yield grouped(cols, new, ids, -1)
        piece, held = int(ids[-1]), [c.slice(tail) for c in cols]
    if held is not None:
        n = len(held[0])
        yield grouped(held, np.arange(n) == 0, np.full(n, piece), None)


def sentence_words(tokens: DataFrame) -> DataFrame:
    """``(ord, sent_id, word_ids, words)``: the words of each sentence by word id, written once.

    A parser gives a sentence's words one after the other, so rows that follow each other
    are put together where they are; only blocks of sentences that lie in several
    pieces (words elsewhere, an ``ord`` that occurs again) are exchanged. A word whose
    ``ord`` or ``sent_id`` is NULL belongs to no sentence and stands alone.
    """
    kind = {f.name: f.dataType.simpleString() for f in tokens.schema}
    block = F.floor(F.col("sent_id") / F.lit(BLOCK_SENTENCES)).cast("bigint")
    pieces = written(tokens.select("ord", "sent_id", block.alias("block"), "word_id", "text").mapInArrow(
        _pieces, f"ord {kind['ord']}, sent_id {kind['sent_id']}, block bigint, piece bigint, "
                 f"word_ids array<{kind['word_id']}>, words array<string>"), "sentences")
    keyed = F.col("ord").isNotNull() & F.col("sent_id").isNotNull()
    split = cut_lineage(pieces.where(keyed).select("ord", "block", "piece").distinct()
                        .groupBy("ord", "block").count().where("count > 1").select("ord", "block"))
    out = ["ord", "sent_id", "word_ids", "words"]
    if split.isEmpty():
        return pieces.select(*out)
    marked = pieces.join(broadcast_measured(split.withColumn("split", F.lit(True))), ["ord", "block"], "left")
    words = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("word_ids", "words"))))
    joined = marked.where("split").groupBy("ord", "sent_id").agg(words.alias("w"))
    return marked.where("split IS NULL").select(*out).unionByName(
        joined.select("ord", "sent_id", F.col("w.word_ids").alias("word_ids"), F.col("w.words").alias("words")))


def _hashes(words: pa.Array) -> np.ndarray:
    """64 bits for each word, digested once for each word of the batch; a NULL has those of another."""
    coded = words.dictionary_encode()
    known = [hashlib.blake2b(w, digest_size=8).digest() for w in coded.dictionary.cast(pa.binary()).to_pylist()]
    return np.frombuffer(b"".join(known) or bytes(8), np.uint64)[coded.indices.fill_null(0).to_numpy()]


def _key(h: np.ndarray, n: int) -> np.ndarray:
    """What stands for a run of n words with rolling hash h."""
    x = (h ^ (h >> np.uint64(31))) * _MIX + np.uint64(n)
    return (x ^ (x >> np.uint64(29))) * _BASE


def _bits(key: np.ndarray) -> list[np.ndarray]:
    """Three places in its chunk."""
    x = (key ^ (key >> np.uint64(32))) * _MIX
    x ^= x >> np.uint64(30)
    return [((x >> np.uint64(19 * i)) & np.uint64(CHUNK_BITS - 1)).astype(np.int64) for i in range(3)]


def _halts(n: int) -> bool:
    return n >= LONG and n & (n - 1) == 0


def _lists(part: pa.RecordBatch, name: str) -> tuple[pa.Array, np.ndarray]:
    """The values of a list column and where each list begins, and the last ends."""
    lists = part.column(name)
    offsets = lists.offsets.to_numpy()
    return lists.flatten(), (offsets - offsets[0]).astype(np.int64)


def _beginnings(text: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For n = 1, 2, ...: the phrases of n words or more by their place, the hash of n words, whether that is all."""
    lists = pc.split_pattern(text, " ")
    hashes, offsets = _hashes(lists.flatten()), lists.offsets.to_numpy().astype(np.int64)
    which, at, n = np.arange(len(text)), offsets[:-1] - offsets[0], 1
    ends, h = offsets[1:] - offsets[0], hashes[at]
    while len(at):
        whole = at + 1 == ends
        yield n, which, h, whole
        which, at, ends, h = which[~whole], at[~whole] + 1, ends[~whole], h[~whole]
        h, n = h * _BASE + hashes[at], n + 1


def _entries(chunks: int) -> Callable:
    """Phrases to ``(chunk, key)`` of them and of the beginnings at which runs are given up."""
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keys = [_key(h if _halts(n) else h[whole], n) for n, _, h, whole in _beginnings(part.column("text"))]
            key = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((key % np.uint64(chunks)).astype(np.int32)), pa.array(key.view(np.int64))],
                                             ["chunk", "key"])
    return entries


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        flat, offsets = _lists(part, "keys")
        keys, made = flat.to_numpy().view(np.uint64), []
        for a, b in zip(offsets, offsets[1:]):
            on = np.zeros(CHUNK_BITS, bool)
            for place in _bits(keys[a:b]):
                on[place] = True
            made.append(np.packbits(on, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([part.column("chunk"), pa.array(made, pa.binary())], ["chunk", "bits"])


def phrase_filter(phrases: DataFrame, n_entries: int) -> np.ndarray:
    """Bits of the phrases' keys, chunk by chunk; of bounded size, so it only ever says "maybe"."""
    chunks = int(min(MAX_CHUNKS, max(1, -(-n_entries * ENTRY_BITS // CHUNK_BITS))))
    parts = phrases.select("text").mapInArrow(_entries(chunks), "chunk int, key bigint") \
        .groupBy("chunk").agg(F.collect_list("key").alias("keys")).mapInArrow(_filled, "chunk int, bits binary")
    bits = np.zeros((chunks, CHUNK_BITS // 8), np.uint8)
    for r in parts.toLocalIterator():
        bits[r["chunk"]] = np.frombuffer(r["bits"], np.uint8)
    return bits


class Listed:
    """A short table of phrases and types as it is shipped: sorted by key, so that a run's rows are searched."""

    def __init__(self, phrases: pa.Table):
        text, kind = (phrases[c].combine_chunks() for c in ("text", "type"))
        keys = np.zeros(len(text), np.uint64)
        for n, which, h, whole in _beginnings(text):
            keys[which[whole]] = _key(h[whole], n)
        order = np.argsort(keys, kind="stable")
        self.keys, self.text, self.type = keys[order], text.take(pa.array(order)), kind.take(pa.array(order))

    def rows(self, key: np.ndarray, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which runs have which rows: same key, and then the same text."""
        first = np.searchsorted(self.keys, key)
        met = np.flatnonzero(self.keys[np.minimum(first, len(self.keys) - 1)] == key)
        n = np.searchsorted(self.keys, key[met], "right") - first[met]
        run = np.repeat(met, n)
        at = np.arange(len(run)) + np.repeat(first[met] - np.cumsum(n) + n, n)
        same = pc.equal(text.take(pa.array(run)), self.text.take(pa.array(at))).to_numpy(zero_copy_only=False)
        return run[same], at[same]


def _runs(filter_bits, lengths: frozenset[int], listed=None) -> Callable:
    """Sentences to their runs of words, of these lengths, that the filter holds; with ``listed``, those in it and their types."""
    longest = max(lengths)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = filter_bits.value

        def maybe(key: np.ndarray) -> np.ndarray:
            chunk, seen = (key % np.uint64(len(bits))).astype(np.int64), np.arange(len(key))
            for place in _bits(key):
                seen = seen[bits[chunk[seen], place[seen] >> 3] >> (place[seen] & 7) & 1 == 1]
            return seen

        for part in batches:
            words, offsets = _lists(part, "words")
            word_ids, hashes = _lists(part, "word_ids")[0], _hashes(words)
            row = np.repeat(np.arange(part.num_rows), np.diff(offsets))
            ends = offsets[1:][row]
            # a word with a space is no word of a phrase; so a run's text tells its words
            fit = pc.fill_null(pc.invert(pc.match_substring(words, " ")), False).to_numpy(zero_copy_only=False)
            at, n = np.flatnonzero(fit), 1
            h = hashes[at]
            while len(at):
                if n in lengths or _halts(n):
                    key = _key(h, n)
                    seen = maybe(key)
                    if n in lengths and len(seen):
                        starts = at[seen]
                        every = words.take(pa.array((starts[:, None] + np.arange(n)).ravel()))
                        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1, dtype=np.int32) * n), every), " ")
                        more = []
                        if listed is not None:
                            run, found = listed.value.rows(key[seen], text)
                            starts, text, more = starts[run], text.take(pa.array(run)), [listed.value.type.take(pa.array(found))]
                        of = pa.array(row[starts])
                        yield pa.RecordBatch.from_arrays(
                            [part.column("ord").take(of), part.column("sent_id").take(of), word_ids.take(pa.array(starts)), text, *more],
                            ["ord", "sent_id", "word_id", "text", "type"][:4 + len(more)])
                    if _halts(n):
                        at, h = at[seen], h[seen]
                if n == longest:
                    break
                on = at + n < ends[at]
                at, h = at[on], h[on]
                on = fit[at + n]
                at, h = at[on], h[on]
                h, n = h * _BASE + hashes[at + n], n + 1
    return runs


def occurrences(sentences: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """``(ord, sent_id, word_id, text, type)`` of every phrase wherever its words follow each other.

    The phrases are written once. The shortest ones, which are met most often, are
    shipped as far as they fit, all others joined by their text.
    """
    phrases = written(gazetteer.where("phrase IS NOT NULL").select(
        F.col("phrase").alias("text"), "type", F.size(F.split("phrase", " ", -1)).alias("n")), "phrases")
    row = F.octet_length("text") + F.coalesce(F.octet_length(F.col("type").cast("string")), F.lit(0)) + 16
    sizes = phrases.groupBy("n").agg(F.count(F.lit(1)).alias("rows"), F.sum(row.cast("bigint")).alias("bytes")).orderBy("n").collect()
    kind = {f.name: f.dataType.simpleString() for f in sentences.schema}
    schema = f"ord {kind['ord']}, sent_id {kind['sent_id']}, word_id {kind['word_ids'][6:-1]}, text string"
    typed = f"{schema}, type {phrases.schema['type'].dataType.simpleString()}"
    spark = sentences.sparkSession
    if not sizes:
        return spark.createDataFrame([], typed)
    entries = sum(r["rows"] * (1 + sum(_halts(1 << i) and 1 << i < r["n"] for i in range(r["n"].bit_length()))) for r in sizes)
    bits = spark.sparkContext.broadcast(phrase_filter(phrases, entries))
    fits = np.cumsum([r["bytes"] for r in sizes]) <= BROADCAST_BYTES_LIMIT
    short = [r["n"] for r, s in zip(sizes, fits) if s]
    long = [r["n"] for r, s in zip(sizes, fits) if not s]
    found = []
    if short:
        listed = spark.sparkContext.broadcast(Listed(phrases.where(F.col("n") <= short[-1]).select("text", "type").toArrow()))
        found.append(sentences.mapInArrow(_runs(bits, frozenset(short), listed), typed))
    if long:
        met = sentences.mapInArrow(_runs(bits, frozenset(long)), schema)
        found.append(met.join(phrases.where(F.col("n") >= long[0]).select("text", "type").hint("merge"), "text")
                     .select("ord", "sent_id", "word_id", "text", "type"))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])
