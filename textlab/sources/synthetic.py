"""Inputs derived from the corpus by fixed rules, standing in for model outputs.

The test tables hold no parsed tokens and no word vectors, so these rules
derive them from ``documents``: the same rule is written in the DuckDB oracle,
which makes the downstream relational operators checkable. They are stand-ins
for an injected parser / vector file, not models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.functions.text import LETTERS_PATTERN

# Universal POS tags assigned by ``length(word) % 6``.
UPOS_BY_LENGTH = ("NOUN", "VERB", "ADJ", "PROPN", "PRON", "DET")
WORDS_PER_SENTENCE = 8


def derived_parse(docs: DataFrame) -> DataFrame:
    """Parse table ``(ord, sent_id, word_id, text, upos, head, deprel)``.

    Words are the letter runs of the whole text; sentences of 8 words; ``head`` points at
    the previous word, some words are roots (``head=0``), and every fifth text's
    first sentence has no root at all.
    """
    words = docs.select("ord", F.posexplode(
        F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(LETTERS_PATTERN), 0)).alias("pos", "w"))
    k = WORDS_PER_SENTENCE
    in_sent = F.pmod(F.col("pos"), F.lit(k))
    no_root = (F.pmod(F.col("ord"), F.lit(5)) == 0) & (F.col("pos") < k)
    upos = F.element_at(F.array(*[F.lit(u) for u in UPOS_BY_LENGTH]),
                        (F.pmod(F.length("w"), F.lit(6)) + 1).cast("int"))
    head = (F.when((in_sent == 0) & ~no_root, F.lit(0))
             .when(in_sent == 0, F.lit(2))
             .when((F.pmod(F.col("ord") + F.col("pos"), F.lit(7)) == 0) & ~no_root, F.lit(0))
             .otherwise(in_sent))
    rel = F.pmod(F.length("w") + F.col("pos"), F.lit(4))
    deprel = F.when(rel == 0, F.lit("nsubj")).when(rel == 1, F.lit("nsubj:pass")).otherwise(F.lit("dep"))
    return words.select(
        "ord",
        F.floor(F.col("pos") / F.lit(k)).cast("int").alias("sent_id"),
        (in_sent + 1).cast("int").alias("word_id"),
        F.col("w").alias("text"),
        upos.alias("upos"),
        head.cast("int").alias("head"),
        deprel.alias("deprel"),
    )


def derived_word_vectors(words: DataFrame, dim: int = 8, missing_prefix: str | None = "0") -> DataFrame:
    """Word-vector table ``(word, vec ARRAY<DOUBLE>)`` from md5 digits of ``word:j``.

    Component j = (hex digit value of md5(word ':' j)[0] + 1 - 8.5) / 8. Words
    whose own md5 starts with ``missing_prefix`` get no vector (a file that
    does not cover the whole vocabulary).
    """
    comps = F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda j: (F.conv(F.substring(F.md5(F.concat(F.col("word"), F.lit(":"), j.cast("string"))), 1, 1),
                          16, 10).cast("double") + F.lit(1.0) - F.lit(8.5)) / F.lit(8.0))
    out = words.select("word")
    if missing_prefix is not None:
        out = out.where(F.substring(F.md5("word"), 1, len(missing_prefix)) != missing_prefix)
    return out.select("word", comps.alias("vec"))


def word_vector_lines(vectors: DataFrame) -> DataFrame:
    """Render a vector table as word-vector text lines (``word v1 ... vd``)."""
    return vectors.select(F.concat_ws(" ", F.col("word"),
                                      F.array_join(F.transform("vec", lambda x: x.cast("string")), " "))
                          .alias("value"))
