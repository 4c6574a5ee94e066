"""Human review overlay (A2): reviewer decisions merged into a reusable labelled set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REVIEW_SCHEMA = "ord bigint, label string, decision string, ts timestamp"


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """Latest decision per row: ``max_by`` over ``ts`` (ties by label, decision)."""
    key = F.struct("ts", "label", "decision")
    return reviews.groupBy("ord").agg(F.max_by(F.struct("label", "decision", "ts"), key).alias("r")) \
                  .select("ord", F.col("r.label").alias("review_label"),
                          F.col("r.decision").alias("decision"), F.col("r.ts").alias("reviewed_at"))


def overlay(labelled: DataFrame, reviews: DataFrame) -> DataFrame:
    """``(ord, label, model_label, source)``.

    ``correct`` replaces the model label; ``confirm`` keeps it but marks it
    human; rows without a review keep the model label with source ``model``.
    """
    last = latest_reviews(reviews)
    j = labelled.select("ord", F.col("label").alias("model_label")).join(last, "ord", "left")
    final = F.when(F.col("decision") == "correct", F.col("review_label")).otherwise(F.col("model_label"))
    source = F.when(F.col("decision").isin("correct", "confirm"), F.lit("human")).otherwise(F.lit("model"))
    return j.select("ord", final.alias("label"), "model_label", source.alias("source"))


def agreement(merged: DataFrame) -> DataFrame:
    """Share of human-reviewed rows whose final label equals the model label."""
    h = merged.where(F.col("source") == "human")
    return h.agg(F.count(F.lit(1)).alias("n_reviewed"),
                 F.count(F.when(F.col("label") == F.col("model_label"), 1)).alias("n_agree")) \
            .withColumn("agreement", F.when(F.col("n_reviewed") > 0,
                                            F.col("n_agree") / F.col("n_reviewed")))
