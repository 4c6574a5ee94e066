"""Benchmark decontamination by one Aho-Corasick automaton (operator 12).

Documents and benchmark items are normalised alike: A-Z in lower case, words
are runs of ASCII letters and digits and of all characters beyond ASCII. The
patterns are the windows of WINDOW consecutive words of every item (a shorter
item is one window whole). They go into one automaton over word numbers (as
DIGITS letters, so that a state has few ways on); a document's words, numbered
by the same vocabulary, run through it once, and every occurrence of every window is found. Words inside
an occurrence are hit; runs of hit words are given as offsets of the original
text.

The patterns are broadcast. Their number and bytes are counted first: an
automaton takes at most about PATTERNS of them and BYTES; a benchmark with more
is dealt by hash to several automata, and the documents, written with their
marks so far, pass one after the other.

Cases: a null text or one without a word has no word and no hit, an item without
a word no window. Items of one id are one item. The words of an item without an
id are hit like others, but it is in no document's items. Rows are looked at
each for itself, so repeated ones get equal results. No items: no hits; no
documents: no rows.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.llm.common import SLICE, add_columns, utf8_slices, without, written

WINDOW = 10
#: Most (window, item) pairs and bytes of windows of one automaton, about.
PATTERNS, BYTES = 200_000, 32 << 20
#: Letters of a word's code and of its alphabets; PATTERNS windows have fewer than BASE ** DIGITS words.
DIGITS, BASE = 3, 128
UNKNOWN = " " * DIGITS
#: ASCII letters in lower case, digits and bytes beyond ASCII stay; all else separates words.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, window): the distinct windows of the items, a window's words joined by spaces."""
    kind = items.schema[item_id].dataType

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                data, bounds = utf8_slices(part.column(1))
                row, found = [], []
                for i in range(part.num_rows):
                    w = words(data[bounds[i]:bounds[i + 1]].tobytes())
                    new = {b" ".join(w[j:j + window]) for j in range(max(1, len(w) - window + 1))} if w else ()
                    row += [i] * len(new)
                    found += new
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int32())), pa.array(found, pa.binary())], ["item", "window"])

    schema = T.StructType([T.StructField("item", kind), T.StructField("window", T.BinaryType())])
    return items.select(item_id, text).mapInArrow(run, schema).distinct()


def code(number: int) -> str:
    """A word's number as DIGITS letters, one alphabet a place, so that a match begins and ends with words."""
    return "".join(chr(BASE * (2 + place) + (number // BASE ** place) % BASE) for place in range(DIGITS))


class Vocabulary(dict):
    """Word to code; a word of no pattern has the code ``UNKNOWN``."""

    def __missing__(self, word: bytes) -> str:
        return UNKNOWN


def automaton(patterns: list[tuple[bytes, list]]) -> tuple[Vocabulary, ahocorasick.Automaton, list[int]]:
    """(vocabulary, automaton, lengths): the automaton gives the number of each window that ends at a word."""
    vocabulary, found, lengths = Vocabulary(), ahocorasick.Automaton(ahocorasick.STORE_INTS), []
    for k, (window, _) in enumerate(patterns):
        w = window.split(b" ")
        for x in w:
            if x not in vocabulary:
                vocabulary[x] = code(len(vocabulary))
        found.add_word("".join([vocabulary[x] for x in w]), k)
        lengths.append(len(w))
    if patterns:
        found.make_automaton()
    return vocabulary, found, lengths


def ranges(hit: np.ndarray) -> np.ndarray:
    """(first, after the last) of each run of hit words."""
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    return np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], axis=1)


def offsets(text: bytes, runs: np.ndarray) -> list[dict]:
    """Runs of words as offsets (code points) of the original text."""
    if not len(runs):
        return []
    word = np.frombuffer(text.translate(_NORMAL), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], word.astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    point = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])  # code points before a byte
    return [{"begin": int(a), "end": int(b)} for a, b in
            zip(point[begin[runs[:, 0]]], point[end[runs[:, 1] - 1]], strict=True)]


def _scan(docs: DataFrame, patterns, text: str, kind: T.DataType, last: bool, drop: list[str]) -> DataFrame:
    """docs with the hits of these patterns added to ``__runs`` and ``__items`` (words), and, if last, the results."""
    arrow_items = {f.name: f.type for f in _arrow(kind)}["items"]

    def make():
        known = patterns.value
        vocabulary, found, lengths = automaton(known)

        def work(column, runs_before, items_before):
            data, bounds = utf8_slices(column)
            n_words, n_hit, runs_out, items_out, spans = [], [], [], [], []
            for i, (before, old) in enumerate(zip(runs_before.to_pylist(), items_before.to_pylist(), strict=True)):
                body = data[bounds[i]:bounds[i + 1]].tobytes()
                w = words(body)
                change, items = None, dict.fromkeys(old)
                for r in before:
                    change = np.zeros(len(w) + 1, np.int32) if change is None else change
                    change[r["begin"]] += 1
                    change[r["end"]] -= 1
                seen = set()
                for at, k in found.iter("".join(map(vocabulary.__getitem__, w))) if known and w else ():
                    change = np.zeros(len(w) + 1, np.int32) if change is None else change
                    end = (at + 1) // DIGITS
                    change[end - lengths[k]] += 1
                    change[end] -= 1
                    if k not in seen:
                        seen.add(k)
                        items |= dict.fromkeys(known[k][1])
                runs = np.zeros((0, 2), np.int64) if change is None else ranges(np.cumsum(change[:-1]) > 0)
                n_words.append(len(w))
                n_hit.append(int((runs[:, 1] - runs[:, 0]).sum()))
                runs_out.append([{"begin": int(a), "end": int(b)} for a, b in runs])
                items_out.append(list(items))
                spans.append(offsets(body, runs))
            span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            if not last:
                return [pa.array(runs_out, span), pa.array(items_out, arrow_items)]
            return [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items_out, arrow_items),
                    pa.array(spans, span)]
        return work

    fields = _results(kind) if last else _marks(kind)
    return add_columns(docs, [text, "__runs", "__items"], fields, make, [*drop, "__runs", "__items"] if last else [])


_SPAN = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _marks(kind: T.DataType) -> list[T.StructField]:
    return [T.StructField("__runs", _SPAN), T.StructField("__items", T.ArrayType(kind))]


def _results(kind: T.DataType) -> list[T.StructField]:
    return [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
            T.StructField("items", T.ArrayType(kind)), T.StructField("spans", _SPAN)]


def _arrow(kind: T.DataType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType(_results(kind)))


def scan(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
         window: int = WINDOW, drop_text: bool = False, patterns: int = PATTERNS) -> DataFrame:
    """docs with n_words, n_hit, items (ids of items with windows in the text) and spans (offsets of hit words)."""
    kind, context = items.schema[item_id].dataType, docs.sparkSession.sparkContext
    every = written(windows(items, item_id, item_text, window), "windows")
    n, size = every.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("window")), F.lit(0))).first()
    pieces = max(1, -(-n // patterns), -(-size // BYTES))
    marked = without(docs, ["n_words", "n_hit", "items", "spans", "__runs", "__items"]) \
        .withColumn("__runs", F.array().cast(_SPAN)).withColumn("__items", F.array().cast(T.ArrayType(kind)))
    for k in range(pieces):
        piece = every.where(F.pmod(F.xxhash64("window", "item"), F.lit(pieces)) == k) \
            .groupBy("window").agg(F.collect_set("item").alias("items"))
        known = context.broadcast([(bytes(r["window"]), list(r["items"])) for r in piece.collect()])
        last = k == pieces - 1
        marked = _scan(marked, known, text, kind, last, [text] if drop_text else [])
        if not last:
            marked = written(marked, "marked")
    return marked


def clean(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs without those that hold a window of an item."""
    names = [c for c in docs.columns if c.lower() not in {"n_words", "n_hit", "items", "spans"}]
    return scan(docs, items, text, **options).where("n_hit = 0").select(*[F.col(f"`{c}`") for c in names])
