"""Quality classifier by nearest-neighbour voting (operator 8).

Texts are counted into terms: trigrams of byte classes (letters by case,
digits, spaces, kinds of marks), hashed byte pairs, and marks for how much of
the text repeats itself. Weighted by rarity, the terms of a bounded sample of
labelled texts give a latent semantic space (truncated SVD). The sample's
vectors and labels are broadcast; every text is projected, its cosine with
every labelled vector is computed in blocks, and the NEIGHBOURS nearest vote
with a power of their similarity as weight.

Sample: of each label, the PER_LABEL labelled rows of the smallest hash of
their id. Only their terms (compressed) come to the driver. Everything
broadcast is bounded by PER_LABEL, TERMS and RANK.

Cases: a null text is the empty text; a text without a term, or one whose
neighbours all have similarity 0, gets the share of label 1 in the sample
(0.5 if there is no sample). An id with several labels counts as 1 only if all
are; an id's repeated rows are one labelled text. Equal texts get equal
scores. No rows give no rows.
"""

from __future__ import annotations

import zlib
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.llm.common import add_columns, sample_of_each, tidy

PER_LABEL, RANK, NEIGHBOURS = 2000, 48, 7
#: A neighbour's vote weighs its cosine to this power.
SHARPEN = 8
#: Byte classes, by the bytes that belong to them; others are the last class.
CLASSES = [b" ", b"\n\r", b"\t\v\f", bytes(range(97, 123)), bytes(range(65, 91)), b"0123456789", b".", b",", b"!", b"?;:",
           b"'\"-", b"()[]{}", b"#$%&*@", b"|/\\<>=_~^+`", bytes(range(128, 256))]
KINDS, PAIRS = 16, 2048
#: Upper ends of the steps of a share that is a term.
STEPS = np.array([0.0, 0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
SHARES = 4
TERMS = KINDS**3 + PAIRS + SHARES * (len(STEPS) + 1)
#: How much the three blocks of terms weigh.
BLOCKS = (1.0, 0.5, 0.7)

_CLASS = np.full(256, len(CLASSES), np.int64)
for _i, _c in enumerate(CLASSES):
    _CLASS[list(_c)] = _i


def terms(text: str) -> np.ndarray:
    """Term weights of a text: square roots of shares, each block of length 1; all 0 for an empty text."""
    out = np.zeros(TERMS, np.float32)
    data = np.frombuffer(text.encode(), np.uint8).astype(np.int64)
    if len(data) < 3:
        return out
    kind = _CLASS[data]
    three = np.bincount((kind[:-2] * KINDS + kind[1:-1]) * KINDS + kind[2:], minlength=KINDS**3)
    two = np.bincount((((data[:-1] << 8) | data[1:]) * 40503 >> 4) % PAIRS, minlength=PAIRS)
    words, lines = text.split(), [x for x in text.split("\n") if x]
    shares = (sum(map(eq, words, words[1:])) / max(1, len(words) - 1), 1 - len(set(words)) / max(1, len(words)),
              1 - len(set(lines)) / max(1, len(lines)), min(1.0, len(words) / max(1, len(data)) * 2))
    at = 0
    for weight, block in zip(BLOCKS, (three, two), strict=False):
        out[at:at + len(block)] = weight * np.sqrt(block / block.sum())
        at += len(block)
    for share in shares:
        out[at + np.searchsorted(STEPS, share)] = BLOCKS[2] / np.sqrt(SHARES)
        at += len(STEPS) + 1
    return out


class Model:
    """Projection into the latent space, and the labelled vectors there."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, seed: int = 7):
        """x: the sample's terms; it is weighted in place, so that the driver holds it once."""
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float32)
        self.idf = np.log((1 + len(x)) / (1 + np.count_nonzero(x, axis=0))).astype(np.float32) + 1
        x *= self.idf
        self.projection = np.zeros((x.shape[1], 1), np.float32)
        if len(x):
            # truncated SVD by a random start and two rounds of subspace iteration
            rank = min(RANK, *x.shape)
            basis = np.random.default_rng(seed).normal(size=(x.shape[1], rank + 8)).astype(np.float32)
            for _ in range(3):
                left, _ = np.linalg.qr(x @ basis)
                basis, _ = np.linalg.qr(x.T @ left)
            _, _, right = np.linalg.svd(x @ basis, full_matrices=False)
            self.projection = np.ascontiguousarray((basis @ right[:rank].T).astype(np.float32))
        self.vectors = self.unit(x @ self.projection)

    @staticmethod
    def unit(v: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(n > 0, n, 1)

    def place(self, x: np.ndarray) -> np.ndarray:
        return self.unit((x * self.idf) @ self.projection)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(x), self.prior)
        cosine = np.maximum(self.place(x) @ self.vectors.T, 0)
        k = min(NEIGHBOURS, cosine.shape[1])
        nearest = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.take_along_axis(cosine, nearest, 1).astype(np.float64) ** SHARPEN
        whole = weight.sum(axis=1)
        vote = (weight * self.labels[nearest]).sum(axis=1) / np.where(whole > 0, whole, 1)
        return np.clip(np.where(whole > 0, vote, self.prior), 0, 1)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
          label: str = "quality") -> Model:
    """A model of the labelled rows that aren't held out."""
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(doc_id))) \
        .groupBy(doc_id).agg(F.min(label).alias("__label"))
    chosen = sample_of_each(known, "__label", doc_id, PER_LABEL).limit(2 * PER_LABEL)

    def make():
        def work(column):
            return [pa.array([zlib.compress(terms(t).astype(np.float16).tobytes(), 1)
                              for t in column.fill_null("").to_pylist()], pa.binary())]
        return work

    sample = docs.select(doc_id, text).join(F.broadcast(chosen), doc_id)
    counted = add_columns(sample, [text], [T.StructField("__terms", T.BinaryType())], make, [text])
    rows = counted.groupBy(doc_id).agg(F.min("__label").alias("label"), F.min("__terms").alias("terms")).collect()
    rows.sort(key=lambda r: r[doc_id])
    x = np.zeros((len(rows), TERMS), np.float32)
    for i, r in enumerate(rows):
        x[i] = np.frombuffer(zlib.decompress(r["terms"]), np.float16)
    labels_ = np.array([r["label"] for r in rows], np.float32)
    del rows
    model = Model(x, labels_)
    del x
    tidy()
    return model


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score", drop_text: bool = False) -> DataFrame:
    """docs with its score, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def work(column):
            x = np.stack([terms(t) for t in column.fill_null("").to_pylist()])
            some = x.any(axis=1)
            out = np.full(len(x), own.prior)
            if some.any():
                out[some] = own.score(x[some])
            return [pa.array(out)]
        return work

    return add_columns(docs, [text], [T.StructField(name, T.DoubleType())], make, [text] if drop_text else [])
