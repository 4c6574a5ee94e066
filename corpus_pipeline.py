"""From raw documents to token ids: five stages, each an operator of textlab.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of ``docs``. Null and empty texts pass through every stage like other
texts; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.llm import bpe, mixing, quality, simhash, spans
from textlab.llm.common import fresh, table, written
from textlab.llm.queries import THRESHOLD, tokenizer
from textlab.session import prepare


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold; labels are those of sf_dir."""
    prepare(spark)
    model = quality.learn(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    score = fresh(docs, "__score")
    return quality.score(docs, model, name=score).where(F.col(score) >= THRESHOLD).drop(score)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id."""
    prepare(spark)
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the sentences of repeated spans; n_chars follows the text."""
    prepare(spark)
    out = spans.cleaned(docs)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as many times as the mix takes them."""
    prepare(spark)
    return mixing.emit(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids (little-endian unsigned 32-bit numbers) and how many they are; the text
    returned is what the ids decode to."""
    prepare(spark)
    back = bpe.encode(docs.withColumn("__null", F.col("text").isNull()), *tokenizer(), drop_text=True,
                      decoded="__text")
    text = F.when(~F.col("__null"), F.col("__text").cast("string")).alias("text")
    kept = [c for c in docs.columns if c == "text" or c in back.columns and c not in ("ids", "n_tokens")]
    return back.select(*[text if c == "text" else F.col(f"`{c}`") for c in kept], "ids", "n_tokens")


STAGES = [("quality classifier", good), ("SimHash near-dedup", distinct), ("substring dedup", without_repeats),
          ("mixing sources to target weights", mixed), ("byte-level BPE encoding and decoding", encoded)]

#: A trained classifier, SimHash and BPE are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
