"""Online analysis of arriving texts (A3) with Structured Streaming.

A file stream of texts is processed with ``foreachBatch``: every micro-batch
is a static DataFrame that goes through the same batch operators (strip,
tokens, ids, pooled vectors) with the vocabulary and word vectors fitted
offline. Output rows are keyed by ``ord``; each micro-batch is written to its
own folder, overwritten on retry, so a restart after an executor or driver
loss writes each text once. :func:`run_online` is stateless: no watermark, window or state store.

:func:`run_reusing` analyses a text once a stream: results of a slow step (a
labeller, an encoder) are kept by the text's digest, and only texts not met before reach it, whole
micro-batches at a time, which a state store's one call a key would not allow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.operators import classify, cluster, minibatch, vectors
from textlab.operators.common import cut_lineage, lookup, with_ordinal
from textlab.session import scratch_path


def score_batch(batch: DataFrame, vocab: DataFrame, table: DataFrame, dim: int,
                polarity=None, centres: DataFrame | None = None) -> DataFrame:
    """The per-micro-batch transform: ``(ord, vec, n_tokens[, prediction, p_positive, polarity][, center])``."""
    out = vectors.sentence_vectors_from(batch, vocab, table, dim)
    if polarity is not None:
        out = out.join(classify.score(polarity, classify.hashed_features(batch)), "ord")
    if centres is not None:
        near = cluster.nearest_centre(out.select(F.col("ord").alias("id"), "vec"), centres)
        out = out.join(near.withColumnRenamed("id", "ord"), "ord")
    return out


def run_online(spark: SparkSession, source: str, schema: str, key: str, text: str,
               vocab: DataFrame, word_vectors: DataFrame, dim: int,
               out_path: str | None = None, checkpoint: str | None = None,
               glob: str | None = None, max_files: int | None = None, polarity=None,
               centres: DataFrame | None = None) -> str:
    """Process everything available in the folder ``source``, or in the files and folders that it matches as a
    pattern (trigger ``availableNow``), optionally only files matching ``glob`` and ``max_files`` a micro-batch; returns the sink path.

    The vector table is built once, before the first micro-batch. With a fitted
    ``polarity`` rows also get ``polarity, p_positive``, with ``centres`` the ``center``.
    """
    table = cut_lineage(vectors.vector_table(vocab, word_vectors, dim))
    out_path = out_path or scratch_path(spark, "online-out")
    checkpoint = checkpoint or scratch_path(spark, "online-ckpt")
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    stream = reader.parquet(source) \
        .select(F.col(key).cast("bigint").alias("ord"), F.col(text).alias("text"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        # one folder per micro-batch, overwritten on retry: exactly-once output
        score_batch(batch, vocab, table, dim, polarity, centres) \
            .write.mode("overwrite").parquet(f"{out_path}/data/batch_id={batch_id}")

    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    return out_path


def read_online(spark: SparkSession, out_path: str) -> DataFrame:
    return spark.read.parquet(f"{out_path}/data").drop("batch_id")


def learn_centres(spark: SparkSession, source: str, schema: str, key: str, vec: str, k: int | None = None,
                  state: str | None = None, checkpoint: str | None = None, first: minibatch.Centres | None = None,
                  max_files: int | None = None) -> str:
    """Mini-batch k-means (C3) over vectors that arrive in ``source``: each micro-batch moves the centres once.

    The centres after a micro-batch are written under its number, and a micro-batch starts from those of the
    number before it, so one that is run again after a loss counts once. Without ``first`` centres, the first
    micro-batch with at least two vectors also gives the start. Returns the folder, for :func:`read_centres`.
    """
    state = state or scratch_path(spark, "centres")
    checkpoint = checkpoint or scratch_path(spark, "centres-ckpt")
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.parquet(source).select(F.col(key).cast("bigint").alias("id"), F.col(vec).alias("vec"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        before = read_centres(spark, state, before=batch_id) or first
        now = before or minibatch.start(batch, k)
        if now is not None:
            minibatch.learn(now, batch).table(spark).coalesce(1) \
                .write.mode("overwrite").parquet(f"{state}/batch_id={batch_id}")

    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start().awaitTermination()
    return state


def read_centres(spark: SparkSession, state: str, before: int | None = None) -> minibatch.Centres | None:
    """Centres after the last micro-batch written (under number ``before``); None where there is none."""
    last = max((b for b in _written(spark, state) if before is None or b < before), default=None)
    return None if last is None else minibatch.Centres.of(spark.read.parquet(f"{state}/batch_id={last}"))


def _written(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the micro-batches whose folder under ``path`` is complete."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    return sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(root)
                  if f.isDirectory() and f.getPath().getName().startswith("batch_id=")
                  and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")))


def _forget(spark: SparkSession, path: str, batch_id: int) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch_id={batch_id}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run_reusing(spark: SparkSession, source: str, schema: str, key: str, text: str,
                analyse: Callable[[DataFrame], DataFrame], out_path: str | None = None, store: str | None = None,
                checkpoint: str | None = None, keep: int | None = None, max_files: int | None = None) -> str:
    """Rows ``(ord, ...)`` for the texts that arrive in ``source``, each different text analysed once.

    ``analyse`` takes the new different texts of a micro-batch as ``(ord, text)``, ``ord`` counting
    from 0, and returns at most one row an ``ord`` with its results; a text without a row (a failed call, say) has NULL
    results now and is asked for again when it returns. They go to ``store`` under the micro-batch's number. A
    micro-batch reads results of earlier numbers only and overwrites its own, so one that
    is run again after a loss gives the same rows. With ``keep``, results serve that many micro-batches after their own,
    then they are removed and made again if the text returns; without, they are kept.

    A NULL text is not analysed: its results are NULL. The empty text is a text. Rows that repeat stay. A text that
    fills most of a micro-batch is looked up by broadcast, its rows are not sent to one task. Returns the sink path.
    """
    out_path = out_path or scratch_path(spark, "reuse-out")
    store = store or scratch_path(spark, "reuse-store")
    checkpoint = checkpoint or scratch_path(spark, "reuse-ckpt")
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.parquet(source).select(F.col(key).cast("bigint").alias("ord"), F.col(text).alias("text"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = cut_lineage(batch.withColumn("digest", F.sha2("text", 256)))
        wanted = rows.where(F.col("digest").isNotNull()).groupBy("digest") \
            .agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("__n"))
        earlier = [b for b in _written(spark, store) if b < batch_id and (keep is None or b >= batch_id - keep)]
        known = spark.read.parquet(*[f"{store}/batch_id={b}" for b in earlier]) if earlier else None
        new = wanted if known is None else wanted.join(known.select("digest"), "digest", "left_anti")
        numbered = with_ordinal(new.select("digest", "text"), ["digest"]) \
            .select((F.col("rn") - 1).alias("ord"), "digest", "text")
        if known is None or not numbered.isEmpty():
            own = f"{store}/batch_id={batch_id}"
            numbered.select("ord", "digest").join(analyse(numbered.select("ord", "text")), "ord") \
                .drop("ord").write.mode("overwrite").parquet(own)
            made = spark.read.parquet(own)
            known = made if known is None else known.unionByName(made)
        results = wanted.select("digest", "__n").join(known, "digest")
        dealt = F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string"))
        lookup(rows.select("ord", "digest"), results, "digest", "__n", dealt, rows.count()).drop("digest") \
            .write.mode("overwrite").parquet(f"{out_path}/data/batch_id={batch_id}")
        if keep is not None:
            for b in _written(spark, store):
                if b <= batch_id - keep:      # the next micro-batch does not read it
                    _forget(spark, store, b)

    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start().awaitTermination()
    return out_path
