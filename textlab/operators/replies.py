"""Replies kept by the content of their prompt, as a folder of commits.

Each run writes one commit, ``commit=<id>``, which counts from the moment its success
mark is there, so a run that dies leaves nothing behind that is read, and two writers
do not disturb each other. A compaction is such a commit too: the best reply of
each prompt, and the names of the commits that it stands for, written together. What a compaction
replaced is deleted by the next one, so a reader that lists the folder meanwhile still finds its files.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPLY_SCHEMA = "prompt_key string, reply string, error string, run bigint"
_SCHEMA = REPLY_SCHEMA + ", replaces string, commit string"
# Replies are a few thousand bytes: some 200 MB a file.
ROWS_PER_FILE = 100_000


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def commits(spark: SparkSession, path: str) -> list[str]:
    """Names of the finished commits under ``path``, replaced ones included (one a run or compaction)."""
    fs, _ = _folder(spark, path)
    marks = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commit=*/_SUCCESS"))
    return sorted(m.getPath().getParent().getName()[len("commit="):] for m in marks or [])


def _load(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    if not names:
        return spark.createDataFrame([], _SCHEMA)
    return spark.read.schema(_SCHEMA).option("basePath", path).parquet(*[f"{path}/commit={n}" for n in names])


def _replaced(spark: SparkSession, path: str, names: list[str]) -> set[str]:
    """Commits that a compaction among ``names`` stands for (names only: one row a commit)."""
    return {r[0] for r in _load(spark, path, names).where("replaces IS NOT NULL").select("replaces").distinct().collect()}


def _live(spark: SparkSession, path: str) -> list[str]:
    """Finished commits that no compaction stands for."""
    names = commits(spark, path)
    gone = _replaced(spark, path, names)
    return [n for n in names if n not in gone]


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All replies and failures of live commits; a prompt may have several rows."""
    return _load(spark, path, _live(spark, path)).where(F.col("prompt_key").isNotNull()).drop("replaces", "commit")


def append(replies: DataFrame, path: str) -> str:
    """Write ``replies`` as one commit and return its name."""
    name = uuid.uuid4().hex
    if "replaces" not in replies.columns:
        replies = replies.withColumn("replaces", F.lit(None).cast("string"))
    replies.select("prompt_key", "reply", "error", F.col("run").cast("bigint").alias("run"), "replaces") \
           .write.parquet(f"{path}/commit={name}")
    return name


def best(replies: DataFrame) -> DataFrame:
    """One row a prompt: its latest successful reply, else its latest failure; ``run`` is its last run.

    Rows of one run that differ (two writers) are ranked by their text, so the choice does not depend on order.
    """
    order = F.struct(F.col("error").isNull().alias("ok"), "run", F.coalesce("reply", "error", F.lit("")).alias("text"))
    return replies.groupBy("prompt_key").agg(F.max_by(F.struct("reply", "error"), order).alias("_r"),
                                             F.max("run").alias("run")) \
                  .select("prompt_key", "_r.reply", "_r.error", "run")


def compact(spark: SparkSession, path: str, rows_per_file: int = ROWS_PER_FILE) -> str | None:
    """Put the best reply of every prompt into one commit that stands for all live ones; its name.

    Commits finished meanwhile stay live, and two compactions at once leave two equal rows
    a prompt, which the next one merges. Folders that an earlier compaction replaced are deleted.
    Nothing happens (None) where fewer than two commits are live.
    """
    names = commits(spark, path)
    old = _replaced(spark, path, names)
    live = [n for n in names if n not in old]
    if len(live) < 2:
        return None
    rows = best(_load(spark, path, live).where(F.col("prompt_key").isNotNull()))
    files = max(1, -(-rows.count() // rows_per_file))
    rows = rows.repartition(files, "prompt_key").withColumn("replaces", F.lit(None).cast("string"))
    still = [n for n in names if n in old]
    marks = spark.createDataFrame([(None, None, None, None, n) for n in live + still],
                                  REPLY_SCHEMA + ", replaces string").coalesce(1)
    name = append(rows.unionByName(marks), path)
    for n in still:
        fs, folder = _folder(spark, f"{path}/commit={n}")
        fs.delete(folder, True)
    return name
