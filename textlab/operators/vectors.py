"""Sentence vectors.

Native path (E7): tokens -> vocabulary ids -> word-vector table -> masked mean
pooling (numpy, by batches of texts) -> L2 norm. Injected encoders (E1) run in
``mapInPandas`` on distinct texts only and are joined back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.config import DEFAULTS, VectorSettings, VocabSettings
from textlab.functions import vectors as V
from textlab.operators import corpus
from textlab.operators.common import cut_lineage
from textlab.operators.vocab import token_ids

NOISE_SCALE = 0.01
# The vocabulary's vectors as doubles: 50,000 x 300 dims is 123 MB a copy.
POOL_BROADCAST_BYTES = 160 * 1024 * 1024
# Texts whose vectors a task looks up at a time.
POOL_ROWS = 512


def _seeded_noise(word: str, dim: int) -> F.Column:
    """N(0, 0.01) per component, seeded by the word (Box-Muller on xxhash64)."""
    def unif(j, salt):
        h = F.pmod(F.xxhash64(F.col(word), j, F.lit(salt)), F.lit(2147483647))
        return (h.cast("double") + F.lit(1.0)) / F.lit(2147483648.0)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.sqrt(
        F.lit(-2.0) * F.log(unif(j, 1))) * F.cos(F.lit(2 * np.pi) * unif(j, 2)) * F.lit(NOISE_SCALE))


def vector_table(vocab: DataFrame, word_vectors: DataFrame, dim: int,
                 fill: str = "zero", settings: VocabSettings = DEFAULTS.vocab) -> DataFrame:
    """``(id, vec ARRAY<DOUBLE>)`` for every vocabulary id.

    ``[PAD]`` is zero; words with a vector keep it (one per word); words
    without get zero (``fill="zero"``) or noise seeded by the word
    (``fill="seeded"``); ``[UNK]`` is the mean of the vectors actually found.
    """
    wv = word_vectors.select("word", V.to_double("vec").alias("vec"))
    words = vocab.where(F.col("id") >= 2).select("word", "id")
    j = words.join(wv, "word", "left")
    missing = V.zeros(dim, "double") if fill == "zero" else _seeded_noise("word", dim)
    table = j.select("id", F.coalesce(F.col("vec"), missing).alias("vec"), F.col("vec").isNotNull().alias("found"))
    found = table.where("found")
    unk = found.agg(Summarizer.mean(array_to_vector("vec")).alias("m"),
                    F.count(F.lit(1)).alias("n"))
    unk = unk.select(F.lit(settings.unk_id).cast("bigint").alias("id"),
                     F.when(F.col("n") > 0, vector_to_array("m")).otherwise(V.zeros(dim, "double")).alias("vec"))
    pad = vocab.sparkSession.createDataFrame([(settings.pad_id,)], "id bigint") \
        .select("id", V.zeros(dim, "double").alias("vec"))
    return table.select("id", "vec").unionByName(unk).unionByName(pad)


def mean_pool(ids: DataFrame, table: DataFrame, dim: int,
              settings: VocabSettings = DEFAULTS.vocab) -> DataFrame:
    """``(ord, vec ARRAY<DOUBLE>, n_tokens)`` - mean of token vectors over non-pad positions.

    ``ids(ord, pos, id)`` may hold one NULL row per empty text, which pools to
    the zero vector. The vector table (at most ``max_size`` rows of ``dim``
    floats) is shipped once per task when that bound fits: then only the ids of a text
    meet, and its vectors are added where they are looked up.
    """
    if settings.max_size * (dim * 8 + 64) > POOL_BROADCAST_BYTES:
        return _pooled_by_join(ids, table, dim)
    known = table.select("id", V.to_double("vec").alias("vec")).where("vec IS NOT NULL").toArrow()
    names, at = np.unique(known["id"].to_numpy().astype(np.int64), return_inverse=True)
    mat, times = np.zeros((len(names) + 1, dim)), np.ones(len(names) + 1, np.int64)   # last: ids without a vector
    if len(names):
        np.add.at(mat, at, known["vec"].combine_chunks().flatten().to_numpy().reshape(-1, dim))
        times[:-1] = np.bincount(at)
    del known
    shipped = table.sparkSession.sparkContext.broadcast((names, mat, times))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, mat, times = shipped.value
        for batch in batches:
            for s in range(0, batch.num_rows, POOL_ROWS):
                part = batch.slice(s, POOL_ROWS)
                lists = part.column("ids")
                n, tokens = pc.list_value_length(lists).to_numpy(), lists.flatten().to_numpy().astype(np.int64)
                at = np.searchsorted(names, tokens)
                at[at < len(names)] = np.where(names[at[at < len(names)]] == tokens[at < len(names)],
                                               at[at < len(names)], len(names))
                mean, met = np.zeros((len(n), dim)), np.zeros((len(n), dim))
                count, first = np.zeros(len(n), np.int64), np.cumsum(n) - n
                for t in range(n.max(initial=0)):    # means kept up token by token, as Summarizer does
                    on = np.flatnonzero(n > t)
                    row = at[first[on] + t]
                    some = mat[row] != 0
                    met[on] += some
                    mean[on] += np.where(some, (mat[row] - mean[on]) / np.maximum(met[on], 1), 0.0)
                    count[on] += times[row]
                sums = mean * met
                sums /= np.maximum(count, 1)[:, None]
                vec = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * dim), pa.array(sums.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("ord"), vec, pa.array(count.astype(np.int32))],
                                                 ["ord", "vec", "n_tokens"])

    texts = ids.groupBy("ord").agg(F.collect_list(F.col("id").cast("bigint")).alias("ids"))
    kind = texts.schema["ord"].dataType.simpleString()
    return texts.mapInArrow(pool, f"ord {kind}, vec array<double>, n_tokens int")


def _pooled_by_join(ids: DataFrame, table: DataFrame, dim: int) -> DataFrame:
    """:func:`mean_pool` with a table too large to ship: joined by id, summed by text."""
    side = table.select("id", array_to_vector("vec").alias("features"))
    summ = Summarizer.metrics("sum", "count")
    zero = array_to_vector(V.zeros(dim, "double"))
    per = ids.join(side, "id", "left").groupBy("ord").agg(summ.summary(F.coalesce("features", zero)).alias("s"),
                                                          F.count("id").alias("n_tokens"))
    n = F.greatest(F.col("n_tokens"), F.lit(1)).cast("double")
    return per.select("ord", F.transform(vector_to_array(F.col("s.sum")), lambda x: x / n).alias("vec"),
                      F.col("n_tokens").cast("int").alias("n_tokens"))


def sentence_vectors(docs: DataFrame, vocab: DataFrame, word_vectors: DataFrame, dim: int,
                     vocab_settings: VocabSettings = DEFAULTS.vocab,
                     vec_settings: VectorSettings = DEFAULTS.vectors,
                     fill: str = "zero", normalize: bool = True) -> DataFrame:
    """Texts -> ``(ord, vec ARRAY<DOUBLE>)`` unpadded; pad with :func:`at_edge`."""
    table = vector_table(vocab, word_vectors, dim, fill, vocab_settings)
    return sentence_vectors_from(docs, vocab, table, dim, vocab_settings, vec_settings, normalize)


def sentence_vectors_from(docs: DataFrame, vocab: DataFrame, table: DataFrame, dim: int,
                          vocab_settings: VocabSettings = DEFAULTS.vocab,
                          vec_settings: VectorSettings = DEFAULTS.vectors, normalize: bool = True) -> DataFrame:
    """E7 over a vector table that is already built (streams build it once)."""
    tid = token_ids(docs, vocab, vocab_settings).select("ord", "pos", "id")
    pooled = mean_pool(tid, table, dim, vocab_settings)
    vec = V.l2_normalize("vec", vec_settings.norm_eps) if normalize else F.col("vec")
    return pooled.select("ord", vec.alias("vec"), "n_tokens")


def at_edge(vecs: DataFrame, settings: VectorSettings = DEFAULTS.vectors) -> DataFrame:
    """E5: zero-pad (or cut) stored vectors to ``out_dim`` as ARRAY<FLOAT> at the edge."""
    return vecs.withColumn("vec", V.pad_or_cut(F.transform("vec", lambda x: x.cast("float")),
                                               settings.out_dim, "float"))


def normalized(points: DataFrame, settings: VectorSettings = DEFAULTS.vectors) -> DataFrame:
    """E6 over a vector column."""
    return points.withColumn("vec", V.l2_normalize("vec", settings.norm_eps))


# ---------------------------------------------------------------- E1 (injected)
Encoder = Callable[[list[str]], np.ndarray]


class HashingEncoder:
    """Deterministic default encoder: signed feature hashing of tokens, L2-normed.

    A stand-in for an injected model with the same contract (list of texts ->
    float32 [N, dim]); built once per Python worker.
    """

    def __init__(self, dim: int = 64, max_tokens: int = 64):
        self.dim, self.max_tokens = dim, max_tokens
        # letters and digits in a run, any other mark alone (underscore is such a mark)
        self._re = re.compile(r"[^\W_]+|[^\w\s]|_")

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float64)
        for i, t in enumerate(texts):
            toks = self._re.findall((t or "").strip())[: self.max_tokens]
            for tok in toks:
                h = int.from_bytes(hashlib.md5(tok.encode("utf-8")).digest()[:8], "little")
                out[i, h % self.dim] += 1.0 if (h >> 63) & 1 == 0 else -1.0
            if toks:
                out[i] /= len(toks)
        norms = np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
        return (out / norms).astype(np.float32)


_BUILT: dict[str, object] = {}


def per_worker(factory: Callable[[], object]) -> object:
    """What ``factory`` builds, built once in this Python worker.

    The key is the factory's importable name; one without such a name (a
    lambda, a closure) is keyed by its pickled content.
    """
    name = f"{getattr(factory, '__module__', '')}.{getattr(factory, '__qualname__', '')}"
    if "<" in name or name.startswith("__main__") or not getattr(factory, "__qualname__", ""):
        name = hashlib.md5(cloudpickle.dumps(factory)).hexdigest()
    if name not in _BUILT:
        _BUILT[name] = factory()
    return _BUILT[name]


def encode_one(spark, text: str, factory: Callable[[], Encoder] = HashingEncoder) -> DataFrame:
    """E1 single form: a one-row ``(ord, vec)`` DataFrame for one text."""
    return encode_with(spark.createDataFrame([(0, text)], "ord bigint, text string"), factory)


def encode_with(docs: DataFrame, factory: Callable[[], Encoder] = HashingEncoder,
                batch_rows: int = 256) -> DataFrame:
    """``(ord, vec ARRAY<FLOAT>)`` from an injected encoder over Arrow batches.

    Distinct texts are encoded once (P2) and joined back; the encoder is built
    once per Python worker and fed ``batch_rows`` texts per call.
    """
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = per_worker(factory)
        for pdf in it:
            for s in range(0, len(pdf), batch_rows):
                part = pdf.iloc[s:s + batch_rows]
                mat = enc(part["text"].tolist())
                yield pd.DataFrame({"text_key": part["text_key"].values, "n_copies": part["n_copies"].values,
                                    "vec": [row.astype(np.float32) for row in mat]})

    uniq = corpus.distinct_texts(docs).select("text_key", "text", "n_copies")
    # written once: the join back reads it more than once
    encoded = cut_lineage(uniq.mapInPandas(run, "text_key string, n_copies bigint, vec array<float>"))
    return corpus.join_back(docs.select("ord", "text"), encoded, ["vec"], "n_copies").select("ord", "vec")
