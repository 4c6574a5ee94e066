"""The registered queries of this package, one for each operator, and their SQL.

Each is thin: it reads its whole table, applies the operator with production
parameters and derives the digest columns from the operator's results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.llm import (ann, bpe, decontaminate, langid, lm, mixing, quality, runs, sharding, simhash, sketch, spans,
                         whitening)
from textlab.llm.common import table
from textlab.llm.oracles import ORACLES  # noqa: F401

#: Documents of this quality score or more are kept.
THRESHOLD = 0.3


def tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and their bytes back, as digests."""
    path, pattern = tokenizer()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokens = bpe.encode(docs, path, pattern, drop_text=True)
    return bpe.decode(tokens, path, pattern).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.copies(docs).select("doc_id", "size", "source_size", "target",
                                      (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def op3_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences of repeated spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spans.dedup(docs)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf_dir, "documents")
    network = langid.learn(docs.select("doc_id", "text", "lang"))
    return langid.predict(docs.select("doc_id", "text"), network).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document; shards have near equal bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs, 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op6_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return sketch.compare(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every 20th vector."""
    return ann.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), top=20, every=20)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.score(docs, model, drop_text=True).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document under counts over all of them."""
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, shingle=4, max_bits=4).select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, repeats planted by a hash of the id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    planted = runs.with_repeats(docs, "text", F.crc32(F.col("doc_id").cast("string")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    best = F.col("best")
    return runs.detect(planted, drop_text=True).withColumn("best", runs.strongest(F.col("runs"))).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that benchmark items share."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), drop_text=True)
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding."""
    rows = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    parts = F.arrays_zip("whitened", "explained")
    return rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(parts).alias("pos", "part")).select(
        "vec_id", (F.col("pos") + 1).alias("component"), "n", "deviation", F.col("part.whitened").alias("whitened"),
        F.col("part.explained").alias("explained"), "identity_error")


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_mixing": op2_mixing,
    "op3_spans": op3_spans,
    "op4_language": op4_language,
    "op5_sharding": op5_sharding,
    "op6_sketch": op6_sketch,
    "op7_nearest": op7_nearest,
    "op8_quality": op8_quality,
    "op9_lm": op9_lm,
    "op10_simhash": op10_simhash,
    "op11_runs": op11_runs,
    "op12_decontaminate": op12_decontaminate,
    "op13_whitening": op13_whitening,
}
