"""Periodic runs of words by string synchronising sets (operator 11).

A run is a stretch of words with smallest period q and length at least REPEATS*q
that no neighbouring word extends. Periods below SMALL are found directly, by
comparing each word with the one q further on. For t = SMALL, 2*SMALL, ... the
runs with t <= q < 2t come from a synchronising set: v(i) is a hash of the words
i..i+t-1, none where these lie in a run of period t/REPEATS or less (those runs
are known from the steps before); i belongs to the set if the least of
v(i)..v(i+t) is v(i) or v(i+t). That depends on the words i..i+2t-1 alone, and
of t positions in a row one belongs to the set unless a run of small period
holds all of them. So a run with t <= q < 2t has a position i of the set among
its first t, and i+q belongs to it too, with the same 2t words; no position
between has them, as q is the smallest period. Hence each two neighbours of
equal context in the set propose their distance as a period. Proposals are
compared word by word, extended to both sides, and kept if they are runs.

Hashes of t words are made from two of t/2; documents shorter than REPEATS*t
leave before step t, so the work is near proportional to the words. A slice of
documents is worked on as one array, with a number of its own between them.

Cases: words are what lies between spaces and U+0009 to U+000D, compared byte by
byte. A null or empty text has no word, no run and the empty collapsed text. Rows
are looked at each for itself, so repeated ones get equal results. No documents:
no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.llm.common import WORD, add_columns, utf8_slices

#: A run holds its period at least so many times, and has so many words at least.
REPEATS, LEAST = 4, 6
#: Periods below are compared directly; the least step of the synchronising sets.
SMALL = 8
#: Words of a slice of documents, about.
WORDS = 1 << 18
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (xor, shift, multiply)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_min(v: np.ndarray, width: int) -> np.ndarray:
    """The least of v[i..i+width-1] for each i, missing ones as _NONE: block-wise minima from both sides."""
    n = len(v)
    blocks = -(-n // width) + 1
    padded = np.full(blocks * width, _NONE, np.uint64)
    padded[:n] = v
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def stretch(w: np.ndarray, i: int, q: int) -> tuple[int, int]:
    """(start, end) of the longest stretch around i..i+q in which words q apart are equal."""
    def first_change(x: np.ndarray, y: np.ndarray) -> int:
        at, step = 0, 4 * q
        while at < len(x):
            change = x[at:at + step] != y[at:at + step]
            if change.any():
                return at + int(change.argmax())
            at, step = at + step, 2 * step
        return len(x)

    right = first_change(w[i:len(w) - q], w[i + q:])
    left = first_change(w[:i][::-1], w[q:q + i][::-1])
    return i - left, i + right + q


def primitive(w: np.ndarray, start: int, q: int) -> bool:
    """Whether q is the smallest period of a stretch from start that repeats q words at least twice."""
    rest, f = q, 2
    while rest > 1:
        if rest % f:
            f = f + 1 if f * f <= rest else rest
            continue
        while rest % f == 0:
            rest //= f
        if np.array_equal(w[start:start + q], w[start + q // f:start + q // f + q]):
            return False
    return True


def runs_of(w: np.ndarray, doc: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of the runs in w.

    ``doc`` numbers the text of each place and ``ends`` gives a text's end; its place there holds a
    number that comes once.
    """
    found: list[tuple[int, int, int]] = []
    for q in range(1, min(SMALL, len(w))):
        change = np.flatnonzero(w[:-q] != w[q:])
        edge = np.concatenate([[-1], change, [len(w) - q]])
        for k in np.flatnonzero(np.diff(edge) > (REPEATS - 1) * q):
            start = int(edge[k]) + 1
            if primitive(w, start, q):
                found.append((start, int(edge[k + 1]) - start + q, q))
    size = ends - np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    place = np.arange(len(w))
    h, t = mixed(w.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1
    while len(w):
        long = size[doc] >= REPEATS * t  # texts too short for this step leave
        if not long[place].all():
            keep = long[place]
            place, h = place[keep], h[keep]
        if not len(place):
            break
        if t >= SMALL:
            found += _step(w, doc, ends, place, h, t, found)
        # the words of a text are side by side in place too; what reaches over its end is never read
        ahead = np.concatenate([h[t:], np.zeros(min(t, len(h)), np.uint64)])
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + ahead)
        t *= 2
    out = np.array([r for r in found if r[1] >= LEAST], np.int64).reshape(-1, 3)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _step(w, doc, ends, place, h, t, known) -> list[tuple[int, int, int]]:
    """Runs of period t to 2t-1 among the texts that place covers; h are hashes of t words."""
    room = ends[doc[place]] - place
    v = np.where(room >= t, h, _NONE)
    small = [r for r in known if r[2] <= t // REPEATS and r[1] >= t]
    if small:  # highly periodic places: the t words lie in a run of small period
        change = np.zeros(len(w) + 1, np.int64)
        np.add.at(change, [r[0] for r in small], 1)
        np.add.at(change, [r[0] + r[1] - t + 1 for r in small], -1)
        v[np.cumsum(change[:-1])[place] > 0] = _NONE
    low = window_min(v, t + 1)
    after = np.concatenate([v[t:], np.full(min(t, len(v)), _NONE)])
    chosen = np.flatnonzero((room >= 2 * t) & (low != _NONE) & ((low == v) | (low == after)))
    if not len(chosen):
        return []
    context = mixed(h[chosen] * np.uint64(0x9E3779B97F4A7C15) + h[chosen + t])
    order = np.argsort(context, kind="stable")
    one, two = order[:-1], order[1:]
    equal = context[one] == context[two]
    a, b = place[chosen[one[equal]]], place[chosen[two[equal]]]
    near = (b - a >= t) & (b - a < 2 * t) & (doc[a] == doc[b])
    out, seen = [], {}
    for i, q in sorted(zip(a[near].tolist(), (b - a)[near].tolist(), strict=True)):
        if seen.get(q, -1) > i + q:  # lies in the stretch just found
            continue
        start, end = stretch(w, i, q)
        seen[q] = end
        if end - start >= REPEATS * q and primitive(w, start, q):
            out.append((start, end - start, q))
    return out


def find(texts: list[bytes]) -> tuple[list[np.ndarray], list[list[bytes]]]:
    """The runs of each text and its words; slices of about WORDS words are worked on together."""
    out, words, part, size = [], [], [], 0

    def flush() -> None:
        nonlocal part, size
        vocabulary: dict[bytes, int] = {}
        ids = [vocabulary.setdefault(x, len(vocabulary)) for w in part for x in [*w, None]] if part else []
        w = np.array(ids, np.int64)
        lengths = np.array([len(x) for x in part], np.int64)
        ends = np.cumsum(lengths + 1) - 1
        if part:
            w[ends] = len(vocabulary) + np.arange(len(part))
        doc = np.repeat(np.arange(len(part)), lengths + 1)
        rows = runs_of(w, doc, ends)
        begin = ends - lengths
        at = np.searchsorted(rows[:, 0], np.append(begin, len(w)))
        for k in range(len(part)):
            mine = rows[at[k]:at[k + 1]].copy()
            mine[:, 0] -= begin[k]
            out.append(mine)
        part, size = [], 0

    for text in texts:
        w = text.split()
        words.append(w)
        part.append(w)
        size += len(w)
        if size >= WORDS:
            flush()
    flush()
    return out, words


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(change[:-1]) == 0
    return b" ".join([w for w, k in zip(words, kept.tolist(), strict=True) if k])


def detect(docs: DataFrame, text: str = "text", drop_text: bool = False) -> DataFrame:
    """docs with ``runs`` (array of start, length, period; by start, then period) and ``collapsed`` (the text's
    words without the repeats)."""
    def make():
        kind = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

        def work(column):
            data, bounds = utf8_slices(column)
            runs, words = find([data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
            left = [collapsed(w, r).decode() for w, r in zip(words, runs, strict=True)]
            every = np.concatenate([*runs, np.zeros((0, 3), np.int64)])
            at = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
            rows = pa.StructArray.from_arrays([pa.array(every[:, i]) for i in range(3)], fields=list(kind))
            return [pa.ListArray.from_arrays(pa.array(at), rows), pa.array(left, pa.string())]
        return work

    row = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    return add_columns(docs, [text], [T.StructField("runs", T.ArrayType(row)), T.StructField("collapsed", T.StringType())],
                       make, [text] if drop_text else [])


def strongest(runs: Column) -> Column:
    """The run of greatest exact length/period, of equal ones that of smallest start, then period; null if none."""
    better = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, 0),
                       lambda best, r: F.when(better(r, best), r).otherwise(best))


def with_repeats(docs: DataFrame, text: str, hashed: Column) -> DataFrame:
    """docs with a repeat planted into a text for which the unsigned number ``hashed`` ends in 0 (null: none).

    With n words, g = hashed/10, a = g % n and p = 1 + (n-a)/(3 + g%8) (whole quotients), every word i >= a
    becomes the word a + (i-a) % p; the words are then joined by one space.
    """
    words = F.col("__words")
    n, g = F.size(words), F.floor(hashed / 10)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + g % 8))
    planted = docs.withColumn("__words", F.when(hashed % 10 == 0, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))) \
        .withColumn("__a", F.when(n > 0, a)).withColumn("__p", F.when(n > 0, p))
    at = lambda i: F.when(i < F.col("__a"), i).otherwise(F.col("__a") + (i - F.col("__a")) % F.col("__p"))
    joined = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, at(i).cast("int"))), " ")
    return planted.withColumn(text, F.when(n > 0, joined).otherwise(F.col(text))).drop("__words", "__a", "__p")
