"""Tokenisation and vocabulary (V1-V6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlab.config import DEFAULTS, VocabSettings
from textlab.functions.text import token_array
from textlab.operators.common import broadcast_measured, cut_lineage, with_ordinal

# A first occurrence (ord, pos) as one number: a long where positions have POS_BITS bits and ords fit in the
# rest, else a decimal (exact for any 64-bit ord and any int pos, but slower to aggregate).
POS_BITS = 20


def tokens(docs: DataFrame, cjk: bool = False, keep_empty: bool = False, first: int | None = None) -> DataFrame:
    """V1: ``(ord, pos INT, token)`` in text order; pos from 0; with ``first``, that many of a text.

    ``keep_empty`` keeps one row with NULL pos/token for texts without tokens,
    so later per-text aggregates need no join back to ``docs``.
    """
    explode = F.posexplode_outer if keep_empty else F.posexplode
    found = token_array("text", cjk)
    if first is not None:
        found = F.slice(found, 1, first)
    return docs.select("ord", explode(found).alias("pos", "token"))


def tokens_with(docs: DataFrame, segmenter_factory) -> DataFrame:
    """V1 with an injected segmenter (e.g. a dictionary segmenter for Chinese).

    ``segmenter_factory()`` is built once per Python worker and maps one
    stripped text to its token list; runs over Arrow batches. ``(ord, pos, token)``.
    """
    import pandas as pd  # local: only needed on this path

    from textlab.operators.vectors import per_worker

    def run(it):
        seg = per_worker(segmenter_factory)
        for pdf in it:
            o, p, t = [], [], []
            for ord_, text in zip(pdf["ord"].values, pdf["text"].values):
                for i, tok in enumerate(seg((text or "").strip())):
                    o.append(int(ord_))
                    p.append(i)
                    t.append(tok)
            yield pd.DataFrame({"ord": pd.Series(o, dtype="int64"), "pos": pd.Series(p, dtype="int32"),
                                "token": pd.Series(t, dtype="object")})

    return docs.select("ord", "text").mapInPandas(run, "ord bigint, pos int, token string")


def token_freq(toks: DataFrame) -> DataFrame:
    """V2: ``(token, cnt)``; partial + final hash aggregation."""
    return toks.where(F.col("token").isNotNull()).groupBy("token") \
               .agg(F.count(F.lit(1)).alias("cnt"))


def build_vocab(toks: DataFrame, settings: VocabSettings = DEFAULTS.vocab) -> DataFrame:
    """V3: ranked vocabulary ``(word, id BIGINT, cnt BIGINT)`` with the two specials.

    Words with ``cnt >= min_freq`` ranked by count desc, ties by first
    occurrence ``(ord, pos)``; ids from 2; at most ``max_size`` rows including
    ``[PAD]``=0 and ``[UNK]``=1 (cnt NULL). A histogram of the counts (as many
    rows as there are different counts) gives the least count that can enter the
    cap; only words that reach it are ranked, by a distributed range sort with
    partition offsets, so no single task sees all distinct tokens.
    The result is checkpointed (it is small and reused by every encoding join).
    """
    cap = settings.max_size - 2
    own = toks.where(F.col("token").isNotNull() & ~F.col("token").isin(settings.pad_token, settings.unk_token))

    def stats_with(first) -> DataFrame:
        return cut_lineage(own.groupBy("token").agg(
            F.count(F.lit(1)).alias("cnt"), F.min(first).alias("first"), F.max("pos").alias("pos"),
            F.min("ord").alias("low"), F.max("ord").alias("high")).where(F.col("cnt") >= settings.min_freq))

    stats = stats_with(F.shiftleft(F.col("ord").cast("bigint"), POS_BITS) + F.col("pos"))
    most, low, high = stats.agg(F.max("pos"), F.min("low"), F.max("high")).first()
    bound = 1 << (62 - POS_BITS)
    if most is not None and (most >= 1 << POS_BITS or low < -bound or high >= bound):
        stats = stats_with(F.col("ord").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)")
                           + F.col("pos").cast("decimal(11,0)"))
    # the least count that can enter the cap, from the number of words of each count
    above = Window.orderBy(F.col("cnt").desc()).rowsBetween(Window.unboundedPreceding, -1)
    least = stats.groupBy("cnt").agg(F.count(F.lit(1)).alias("words")) \
        .withColumn("before", F.coalesce(F.sum("words").over(above), F.lit(0))).where(F.col("before") < cap) \
        .agg(F.min("cnt")).first()[0] or 0
    ranked = with_ordinal(stats.where(F.col("cnt") >= least), [F.col("cnt").desc(), F.col("first"), F.col("token")],
                          name="rn")
    words = ranked.where(F.col("rn") <= cap).select(
        F.col("token").alias("word"), (F.col("rn") + 1).alias("id"), F.col("cnt"))
    spark = toks.sparkSession
    specials = spark.createDataFrame(
        [(settings.pad_token, settings.pad_id, None), (settings.unk_token, settings.unk_id, None)],
        "word string, id bigint, cnt bigint")
    # a fitted artifact (<= max_size rows) read by several later joins:
    # materialise it once instead of re-deriving the ranking per reference
    return cut_lineage(specials.unionByName(words))


def id_to_word(vocab: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """V4: decode ids to words (inverse vocabulary) by an equi-join on ``id``."""
    inv = vocab.select(F.col("id").alias(id_col), "word")
    return ids.join(broadcast_measured(inv), id_col, "left")


def _vocab_side(vocab: DataFrame) -> DataFrame:
    side = vocab.where(F.col("id") >= 2).select(F.col("word").alias("token"), F.col("id").cast("int").alias("id"))
    return broadcast_measured(side)


def token_ids(docs: DataFrame, vocab: DataFrame, settings: VocabSettings = DEFAULTS.vocab,
              cjk: bool = False) -> DataFrame:
    """Token rows truncated to ``max_length`` with their id (unknown -> ``unk_id``).

    ``(ord, pos, token, id)``; texts with no tokens give one row with NULLs.
    Only the kept tokens are exploded, before the vocabulary join.
    """
    toks = tokens(docs, cjk=cjk, keep_empty=True, first=settings.max_length)
    joined = toks.join(_vocab_side(vocab), "token", "left")
    return joined.withColumn(
        "id", F.when(F.col("pos").isNotNull(), F.coalesce(F.col("id"), F.lit(settings.unk_id))))


def encode_ids(docs: DataFrame, vocab: DataFrame, settings: VocabSettings = DEFAULTS.vocab,
               cjk: bool = False) -> DataFrame:
    """V5: ``(ord, ids ARRAY<INT> of length max_length, n_tokens INT)``.

    First ``max_length`` tokens, unknown -> 1, right-padded with 0; a text
    without tokens is all zeros. Per-text collection is bounded by max_length.
    """
    tid = token_ids(docs, vocab, settings, cjk)
    per_doc = tid.groupBy("ord").agg(
        F.array_sort(F.collect_list(
            F.when(F.col("pos").isNotNull(), F.struct("pos", "id")))).alias("pairs"))
    ids = F.transform(F.col("pairs"), lambda p: p["id"])
    L = settings.max_length
    return per_doc.select(
        "ord",
        F.slice(F.concat(ids, F.array_repeat(F.lit(settings.pad_id), L)), 1, L).alias("ids"),
        F.size("pairs").alias("n_tokens"),
    )


def coverage(vocab: DataFrame, word_vectors: DataFrame) -> DataFrame:
    """V6: ``found, needed, coverage`` - vocabulary words with a vector.

    ``found`` counts distinct words (a word repeated in the vector file counts
    once); ``needed`` is the vocabulary size including the two specials.
    """
    wv = word_vectors.select("word").distinct().withColumn("has_vec", F.lit(1))
    j = vocab.join(wv, "word", "left")
    return j.agg(
        F.count("has_vec").alias("found"),
        F.count(F.lit(1)).alias("needed"),
    ).withColumn("coverage", F.col("found") / F.col("needed"))
