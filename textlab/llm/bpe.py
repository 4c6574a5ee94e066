"""Byte-level BPE encoding and decoding (operator 1).

A text is cut into pieces by the tokenizer's pattern and each piece is merged
on its own. Pieces not met before are merged together in numpy: pieces of like
length form the rows of a padded matrix of token ids, every row merges its
leftmost pair of least rank each round, and rows without a pair left go out
(compaction). The rank of a pair is looked up in an open-addressing hash table
held in two arrays. A worker keeps the words it has met, up to PIECES of them.

Cases: a null text is the empty text and has no ids; the text of special
tokens is ordinary text; every text decodes to its own UTF-8 bytes; repeated
rows give the same ids; no rows give no rows. Pieces of any length are encoded
whole: those over LONG bytes, where a matrix row would be touched once for
each merge, are merged with a heap instead, by the same rule.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from textlab.llm.common import add_columns

NONE = np.int32(2**31 - 1)
#: Upper ends of the length buckets, in bytes; beyond the last, a heap.
BUCKETS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 64, 128)
LONG = BUCKETS[-1]
#: Words that a worker keeps; beyond, it starts anew.
PIECES = 50_000
#: Marks that are a piece of their own after letters.
STOPS = tuple(",.;:!?")
#: Cells of a matrix that are merged at a time.
CELLS = 1 << 20


def read_ranks(path: str) -> bytes:
    """The file of ranks: a line for each token, base64 of its bytes and its rank."""
    with open(path, "rb") as f:
        return f.read()


class Table:
    """Pairs of token ids to the id of their merger, by open addressing in arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1), np.uint64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        self.longest, slot, open_ = 1, self.place(keys), np.arange(len(keys))
        while len(open_):
            free = open_[self.values[slot[open_]] == NONE]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], merged[put]
            open_ = np.setdiff1d(open_, put, assume_unique=True)
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            self.longest += len(open_) > 0

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where the two don't merge, or one of them is padding (-1)."""
        keys = (left.astype(np.int64).astype(np.uint64) << np.uint64(32)) \
            | (right.astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slot = self.place(keys)
        out = np.where(self.keys[slot] == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((self.keys[slot] != keys) & (self.values[slot] != NONE))
        for _ in range(self.longest):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[slot[open_]] == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (self.values[slot[open_]] != NONE)]
        return out


class Bpe:
    """Encoder and decoder over the ranks of a byte-level vocabulary."""

    def __init__(self, ranks_file: bytes, pattern: str):
        self.ranks = {base64.b64decode(a): int(b)
                      for a, b in (line.split() for line in ranks_file.splitlines() if line.strip())}
        self.token = {i: t for t, i in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.odd = regex.compile(r"\s[ \n](?:\s|\Z)").search
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], i) for t, i in self.ranks.items()
                 for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        a, b, c = np.array(pairs, np.int64).reshape(-1, 3).T
        self.table = Table(a, b, c.astype(np.int32))
        self.pairs: dict[int, int] | None = None  # for long pieces, made when one is met
        self.forget()

    def forget(self) -> None:
        self.words, self.pieces = Kept(), Kept()

    def merge_matrix(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows in the order in which they end, their lengths, and their token ids one after another.

        ids: the byte ids of a piece in each row, padded with -1 on the right.
        """
        rows, lengths, flat = [], [], []
        row = np.arange(len(ids))
        rank = np.full(ids.shape, NONE, np.int32)
        rank[:, :-1] = self.table.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(row):
            at = rank.argmin(axis=1)
            here = np.arange(len(row))
            least = rank[here, at]
            ready = least == NONE
            if ready.any():
                ended = ids[ready]
                real = ended >= 0
                rows.append(row[ready])
                lengths.append(real.sum(axis=1))
                flat.append(ended[real])
                keep = ~ready
                ids, rank, row, at, least = ids[keep], rank[keep], row[keep], at[keep], least[keep]
                here = np.arange(len(row))
                if not len(row):
                    break
            ids[here, at] = least
            width = ids.shape[1] - 1
            take = np.arange(width)
            take = take + (take > at[:, None])
            ids = np.take_along_axis(ids, take, 1)
            rank = np.take_along_axis(rank, take, 1)
            if width == 1:
                rank[:] = NONE
                continue
            nxt = np.minimum(at + 1, width - 1)
            rank[here, at] = np.where(at + 1 < width, self.table.rank(ids[here, at], ids[here, nxt]), NONE)
            prev = np.maximum(at - 1, 0)
            left = self.table.rank(ids[here, prev], ids[here, at])
            rank[here, prev] = np.where(at > 0, left, rank[here, prev])
        return np.concatenate(rows), np.concatenate(lengths), np.concatenate(flat)

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece: a heap of pairs over a linked list."""
        if self.pairs is None:
            own = self.table.keys[self.table.values != NONE].tolist()
            self.pairs = dict(zip(own, self.table.values[self.table.values != NONE].tolist(), strict=True))
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n, pair = len(ids), lambda x, y: self.pairs.get(x << 32 | y)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1)
                if (r := pair(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (x := pair(r, ids[after[i]])) is not None:
                    heapq.heappush(heap, (x, i, r, ids[after[i]]))
            if before[i] >= 0:
                k = before[i]
                if (x := pair(ids[k], r)) is not None:
                    heapq.heappush(heap, (x, k, ids[k], r))
        return np.array([x for x in ids if x >= 0], np.int32)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each piece begin, how many they are, and all ids."""
        start, length = np.zeros(len(pieces), np.int64), np.ones(len(pieces), np.int64)
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int32, len(pieces))
        known = np.flatnonzero(whole >= 0)
        start[known] = np.arange(len(known))
        flat, filled = [whole[known]], len(known)
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for i in np.flatnonzero((whole < 0) & (size > LONG)):
            flat.append(self.merge_long(pieces[i]))
            start[i], length[i] = filled, len(flat[-1])
            filled += len(flat[-1])
        bucket = np.searchsorted(BUCKETS, size)
        for k, width in enumerate(BUCKETS):
            own = np.flatnonzero((whole < 0) & (bucket == k))
            step = max(1, CELLS // width)
            for at in range(0, len(own), step):
                some = own[at:at + step]
                data = b"".join([pieces[i].ljust(width, b"\0") for i in some.tolist()])
                ids = self.byte[np.frombuffer(data, np.uint8)].reshape(len(some), width)
                ids[np.arange(width) >= size[some][:, None]] = -1
                rows, n, new = self.merge_matrix(ids)
                start[some[rows]], length[some[rows]] = filled + np.cumsum(n) - n, n
                flat.append(new)
                filled += len(new)
        return start, length, np.concatenate(flat)

    def cut(self, word: str) -> list[str]:
        """Pieces of a word under its key (see keys)."""
        if word.isascii():
            if word.isalpha():
                return [" " + word]
            if word[-1:] in STOPS and word[:-1].isalpha():
                return [" " + word[:-1], word[-1]]
        if word[:1] == "\n":
            return self.split(word[2:] if word[1:2] == "\n" else word)
        return self.split(" " + word)

    def keys(self, text: str) -> list[str]:
        """The words of a text: a new one begins at each space and line end.

        No piece of the pattern goes on over white space that follows something
        else, so a text may be cut there; inside a run of white space only
        before its last character, and only if something else follows. Texts
        with other such places count as one word. A word's key is the word
        without the space before it; with the line end before it; or, at the
        beginning of a text, with two line ends, which no other key has.
        """
        if self.odd(text):
            return ["\n\n" + text]
        first, *rest = text.split("\n")
        out = first.split(" ")
        out[0] = "\n\n" + out[0]
        for line in rest:
            words = line.split(" ")
            words[0] = "\n" + words[0]
            out += words
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        if max(len(self.words), len(self.pieces)) > PIECES:
            self.forget()
        keys = [self.keys(t) for t in texts]
        ids, ends = self.words.runs(list(chain.from_iterable(keys)), self.learn)
        ends = np.concatenate([[0], ends])
        last = np.cumsum([len(k) for k in keys])
        return [ids[ends[e - len(k)]:ends[e]] for k, e in zip(keys, last, strict=True)]

    def learn(self, keys: list[str]) -> None:
        """Keep the token ids of the words under these keys."""
        cut = list(map(self.cut, keys))
        size = np.fromiter(map(len, cut), np.int64, len(cut))
        ids, ends = self.pieces.runs(list(chain.from_iterable(cut)), lambda new: self.pieces.add(
            new, *self.merge([p.encode() for p in new])))
        ends = np.concatenate([[0], ends])
        last = np.cumsum(size)
        self.words.add(keys, ends[last - size], ends[last] - ends[last - size], ids)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


class Kept(dict):
    """Token ids of strings: a number for each, and runs in one array."""

    def __init__(self):
        super().__init__()
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def add(self, strings: list[str], start: np.ndarray, length: np.ndarray, flat: np.ndarray) -> None:
        self.update(zip(strings, range(len(self), len(self) + len(strings)), strict=True))
        self.start = np.append(self.start, start + len(self.flat))
        self.length = np.append(self.length, length)
        self.flat = np.concatenate([self.flat, flat])

    def runs(self, strings: list[str], learn) -> tuple[np.ndarray, np.ndarray]:
        """Their token ids one after another, and where those of each end; learn adds those not kept."""
        found = list(map(self.get, strings))
        if None in found:
            learn(list({s for s, n in zip(strings, found, strict=True) if n is None}))
            found = [self[s] if n is None else n for s, n in zip(strings, found, strict=True)]
        of = np.array(found, np.int64)
        n = self.length[of]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.start[of] - ends + n, n) + np.arange(total)], ends


_LOADED: dict[tuple[str, str], Bpe] = {}


def load(ranks_file: bytes, pattern: str) -> Bpe:
    """One Bpe a worker process for each vocabulary."""
    key = (hashlib.sha256(ranks_file).hexdigest(), pattern)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(ranks_file, pattern)
    return _LOADED[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text",
           ids: str = "ids", n_tokens: str = "n_tokens", drop_text: bool = False,
           decoded: str | None = None) -> DataFrame:
    """docs with its token ids and their number, and as ``decoded`` (if named) the bytes that the ids stand for:
    in the same worker, as a second one a task would hold the vocabulary again.

    ``ids`` is binary: little-endian unsigned 32-bit numbers, as token files
    have them. The driver reads the vocabulary (a file of a megabyte or so)
    and broadcasts it, so executors need no copy.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def make():
        bpe = load(shared.value, pattern)

        def work(column):
            found = bpe.encode(column.fill_null("").to_pylist())
            packed = [x.astype("<u4").tobytes() for x in found]
            out = [pa.array(packed, pa.binary()), pa.array([len(x) for x in found], pa.int64())]
            if decoded:
                out.append(pa.array([bpe.decode(np.frombuffer(x, "<u4")) for x in packed], pa.binary()))
            return out
        return work

    fields = [T.StructField(ids, T.BinaryType()), T.StructField(n_tokens, T.LongType()),
              *([T.StructField(decoded, T.BinaryType())] if decoded else [])]
    return add_columns(docs, [text], fields, make, [text] if drop_text else [])


def decode(tokens: DataFrame, ranks_path: str, pattern: str, ids: str = "ids",
           decoded: str = "decoded") -> DataFrame:
    """tokens with the bytes that its binary ``ids`` stand for; null ids give null."""
    shared = tokens.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def make():
        bpe = load(shared.value, pattern)

        def work(column):
            return [pa.array([None if x is None else bpe.decode(np.frombuffer(x, "<u4"))
                              for x in column.to_pylist()], pa.binary())]
        return work

    return add_columns(tokens, [ids], [T.StructField(decoded, T.BinaryType())], make)
