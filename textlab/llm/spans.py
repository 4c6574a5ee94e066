"""Substring deduplication by sliding sentence spans (operator 3).

A text is cut into sentences (at full stops, question and exclamation marks
and line ends). A sentence of over LONG words is cut on where the hash of the
words before the cut is the least of a window of WINDOW words, so a passage is
cut alike wherever it stands. From every sentence begins a span: the shortest
run of at least SENTENCES sentences with at least WORDS words. Spans are
hashed; of equal spans the first stays, by document id and place, and the
sentences of every other one are removed.

In scripts without spaces every character is a unit: 2 of Chinese or Japanese
count as a word, 6 of Thai, Lao, Khmer, Burmese or Tibetan. A passage that two
texts share loses at most 95 parts (PARTS make a word) before the first cut
that both texts have and LONG words after the last, so with over 50 words,
punctuated or not, it holds a whole span.

Counts come first, aggregated before the shuffle; spans found once go no
further. Spans that very many documents share are broadcast (see lookup). A
document's removed sentences are gathered, which its own length bounds.

Cases: sentences are compared without case, white space reduced to single
spaces. A null text stays null and has no sentence, an empty one stays empty;
what is left of a text keeps its bytes. Rows with a null id come last. Of rows
that share an id, or have none, the one of the smallest hash of id and text is
first; of rows equal in both, any one. Within a row, a span that comes again
goes. Ids are whole numbers. No rows give no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.llm.common import SLICE, add_columns, lookup, tidy, without, written

SENTENCES, WORDS, LONG, WINDOW = 2, 20, 15, 14
#: Parts of a word, of a Chinese or Japanese character and of one of the other scripts without spaces.
PARTS, IDEOGRAPH, LETTER = 6, 3, 1
#: Parts that the hash of a place reads.
GRAM = 2 * PARTS
_SENTENCE = re.compile(r"[^.!?\n。！？]*(?:[.!?\n。！？]+\s*|\Z)")
_WORD = re.compile(r"\s*\S+\s*|\s+")
_IDEOGRAPHS = "\u2e80-\u2fdf\u3001-\u312f\u31a0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\ua000-\ua4cf\uf900-\ufaff\uff01-\uff9f\U00020000-\U0003ffff"
_LETTERS = "\u0e00-\u109f\u1780-\u17ff\u1950-\u19ff\u1a20-\u1aaf"
_UNSPACED = re.compile(f"[{_IDEOGRAPHS}{_LETTERS}]")
_UNIT = re.compile(rf"\s*(?:([{_IDEOGRAPHS}])|([{_LETTERS}])|[^\s{_IDEOGRAPHS}{_LETTERS}]+)\s*|\s+")
_LAST = (1 << 63) - 1


def units(s: str) -> tuple[list[str], list[int]]:
    """Words (characters in scripts without spaces) of a sentence with the space around them, and their parts."""
    if s.isascii() or not _UNSPACED.search(s):
        found = _WORD.findall(s)
        return found, [PARTS] * len(found)
    found = list(_UNIT.finditer(s))
    return [m.group() for m in found], [IDEOGRAPH if m.group(1) else LETTER if m.group(2) else PARTS for m in found]


def size(s: str) -> int:
    """Parts of a sentence, at least those of a word."""
    if s.isascii() or not _UNSPACED.search(s):
        return PARTS * max(1, len(s.split()))
    return max(PARTS, sum(units(s)[1]))


def cuts(found: list[str], parts: list[int]) -> list[int]:
    """Units after which a long sentence is cut: of each window of WINDOW words the one of the least hash (the last
    of equal ones). The hash reads the units of the last GRAM parts."""
    low = [w.strip().lower() for w in found]
    digest = xxhash.xxh32_intdigest
    if min(parts) == PARTS:
        h, at, window = [digest(low[0]), *[digest(f"{a} {b}") for a, b in zip(low, low[1:])]], None, WINDOW
    else:  # a place for each part; only the last of a unit can be chosen
        h, at, window = [], [], WINDOW * PARTS
        for i, n in enumerate(parts):
            j, room = i, GRAM - n
            while j and parts[j - 1] <= room:
                j -= 1
                room -= parts[j]
            h += [1 << 32] * (n - 1) + [digest(" ".join(low[j:i + 1]))]
            at += [i] * n
    out, least = [], -1
    for end in range(window - 1, len(h)):
        begin = end - window + 1
        if least < begin:
            m = min(h[begin:end + 1])
            least = end
            while h[least] != m:
                least -= 1
        elif h[end] <= m:
            m, least = h[end], end
        else:
            continue
        out.append(least)
    return out if at is None else [at[x] for x in out]


def sentences(text: str) -> list[str]:
    """Sentences one after another; together they are the text."""
    out = []
    for s in _SENTENCE.findall(text):
        if len(s) <= 2 * LONG or size(s) <= LONG * PARTS:
            if s:
                out.append(s)
            continue
        found, parts = units(s)
        begin = 0
        for i in cuts(found, parts):
            out.append("".join(found[begin:i + 1]))
            begin = i + 1
        if begin < len(found):
            out.append("".join(found[begin:]))
    return out


def spans(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first sentence and number of sentences of each span of a text."""
    cut = sentences(text)
    words = [s.lower().split() for s in cut]
    count = np.cumsum(np.fromiter(map(size, cut), np.int64, len(cut)))
    before = np.concatenate([[0], count[:-1]]) if len(count) else count
    last = np.maximum(np.searchsorted(count, before + WORDS * PARTS), np.arange(len(count)) + SENTENCES - 1)
    begin = np.flatnonzero(last < len(count))
    if not len(begin):
        return np.zeros(0, np.int64), begin, begin
    digest = xxhash.xxh64_intdigest
    each = np.array([digest(" ".join(w)) for w in words], np.uint64).tobytes()
    h = np.array([digest(each[8 * i:8 * j + 8]) for i, j in zip(begin.tolist(), last[begin].tolist(), strict=True)], np.uint64)
    return h.view(np.int64), begin, last[begin] - begin + 1


def all_spans(rows: DataFrame) -> DataFrame:
    """rows (id, row, text): a row (hash, id, row, place, sentences, first in its row) for each span."""
    schema = "hash long, id long, row long, place int, sentences int, first boolean"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found = [spans(t) for t in part.column("text").fill_null("").to_pylist()]
                n = [len(h) for h, _, _ in found]
                first = []
                for h, _, _ in found:
                    flag = np.zeros(len(h), bool)
                    flag[np.unique(h, return_index=True)[1]] = True
                    first.append(flag)
                ids, row = (np.repeat(part.column(c).to_numpy(), n) for c in ("id", "row"))
                h, place, size = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h, pa.int64()), pa.array(ids, pa.int64()), pa.array(row, pa.int64()),
                     pa.array(place, pa.int32()), pa.array(size, pa.int32()), pa.array(np.concatenate(first))],
                    ["hash", "id", "row", "place", "sentences", "first"])
        tidy()

    return rows.mapInArrow(run, schema)


def told_apart(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, bool]:
    """docs with ``__row``, a number of each row, and whether rows share an id (or have none).

    The number is the hash of id and text. Rows equal in both, of which there are some only if ids are shared, are
    written with numbers of their own.
    """
    hashed = docs.withColumn("__row", F.xxhash64(doc_id, text))
    if docs.groupBy(doc_id).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return hashed, False
    copies = written(hashed.groupBy("__row").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                     .withColumn("__copy", F.lit(True)), "copies")
    total = copies.agg(F.sum("n")).first()[0] or 0
    marked = lookup(hashed, copies, "__row", "n", F.xxhash64(F.monotonically_increasing_id()), total)
    own = F.xxhash64("__row", F.monotonically_increasing_id())
    equal = written(marked.where("__copy").withColumn("__row", own), "equal")
    return marked.where("__copy is null").unionByName(equal).drop("__copy"), True


def removed(rows: DataFrame, doc_id: str = "doc_id", text: str = "text", shared: bool = True) -> DataFrame:
    """(row, spans): of the rows with ``__row``, first sentence and length of each span to remove."""
    cut = rows.select(F.coalesce(F.col(doc_id), F.lit(_LAST)).cast("long").alias("id"),
                      F.col("__row").alias("row"), F.col(text).alias("text"))
    every = written(all_spans(cut), "spans")
    repeated = written(every.groupBy("hash").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
                       .where("n > 1"), "repeated")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    spread = F.xxhash64("row", "place")
    later = lookup(every, repeated, "hash", "n", spread, total).where("low is not null")
    if shared:  # of rows that share the smallest id, that of the smallest number keeps the span
        later = written(later, "later")
        first = written(later.where("id = low").groupBy("hash").agg(
            F.min("row").alias("own"), F.count(F.lit(1)).alias("n")), "owners")
        later = lookup(later, first, "hash", "n", spread, total).where("id <> low or row <> own or not first")
    else:
        later = later.where("id <> low or not first")
    return later.groupBy("row").agg(F.collect_set(F.struct("place", "sentences")).alias("spans"))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with its text without repeated spans, n_sentences (before) and n_removed, which replace columns of these names."""
    out, at = _dedup(docs, doc_id, text)
    counts = ["n_sentences", "n_removed"]
    return out.select(*[F.col(at[c]).alias(c) for c in without(docs, counts).columns], *counts)


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with its text without repeated spans; all other columns stay, whatever their names."""
    out, at = _dedup(docs, doc_id, text)
    return out.select(*[F.col(at[c]).alias(c) for c in docs.columns])


def _dedup(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, dict[str, str]]:
    """docs under hidden names, which clash with none used here, with its cleaned text and the counts; the names."""
    at = {c: f"__c{i}" for i, c in enumerate(docs.columns)}
    kept = at[text]
    docs, doc_id, text = docs.toDF(*at.values()), at[doc_id], at[text]
    rows, shared = told_apart(docs, doc_id, text)
    marks = removed(rows, doc_id, text, shared).select(F.col("row").alias("__row"), F.col("spans").alias("__spans"))
    marked = rows.join(marks, "__row", "left")

    def make():
        def work(column, spans_):
            texts, counts, gone = [], [], []
            for t, marks in zip(column.to_pylist(), spans_.to_pylist(), strict=True):
                if t is None:
                    texts.append(None)
                    counts.append(0)
                    gone.append(0)
                    continue
                s = sentences(t)
                keep = np.ones(len(s), bool)
                for m in marks or ():
                    keep[m["place"]:m["place"] + m["sentences"]] = False
                texts.append(t if keep.all() else "".join([x for x, k in zip(s, keep, strict=True) if k]))
                counts.append(len(s))
                gone.append(int(len(s) - keep.sum()))
            return [pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(gone, pa.int32())]
        return work

    out = add_columns(marked, [text, "__spans"],
                      [T.StructField("__text", T.StringType()), T.StructField("n_sentences", T.IntegerType()),
                       T.StructField("n_removed", T.IntegerType())], make, [text, "__spans", "__row"])
    return out.withColumnRenamed("__text", kept), at
