"""Loading the driver's parquet tables with explicit projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textlab.operators.corpus import as_docs

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical corpus ``(ord, text)`` from ``documents``; ``doc_id`` is dense 0..n-1."""
    return as_docs(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id") \
        .select("ord", "text")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, vec ARRAY<FLOAT>, cluster INT)`` from ``embeddings``."""
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id as id", "embedding as vec", "label as cluster")
