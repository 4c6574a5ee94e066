"""End-to-end jobs: the tag job (texts -> labels -> clusters -> metrics) and
the text-analysis and texts-to-vectors jobs.

Work that depends only on a text runs once per distinct text (P2) and is
joined back by key; clustering and its scores run on distinct labels, each
counted as often as it occurs. Results of slow stages (labeller, encoder) are
written once under the shared checkpoint folder; replies also go to a folder
that the caller names, which later runs reuse.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.config import DEFAULTS, Settings
from textlab.operators import annotate, cluster, corpus, density, minibatch, quality, tagging, vectors, vocab
from textlab.operators.common import cut_lineage, lookup, with_ordinal
from textlab.session import scratch_path


@dataclass
class TagJob:
    status: str                 # "clustered" | "skipped"
    n_samples: int
    labels: DataFrame           # (ord, label, error)
    clusters: DataFrame | None  # (algo, ord, cluster): every text, NULL without a label
    metrics: DataFrame | None   # (algo, space, n_samples, ..., davies_bouldin)
    quarantine: DataFrame       # (batch_id, idx, line, reason): reply lines that name no text


def label_texts(docs: DataFrame, labeller=tagging.rule_labeller, settings: Settings = DEFAULTS,
                store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """L1-L7 on distinct texts, joined back to every row: ``(ord, label, error)``, and the quarantine.

    With ``store`` (a folder that outlives the run) replies are kept by the
    content of their prompt, so a rerun or another run repeats no successful call.
    """
    uniq = corpus.distinct_texts(docs).select(F.col("rep_ord").alias("ord"), "text", "text_key", "n_copies")
    batched = tagging.assign_batches(uniq.select("ord", "text"), settings.tags, dense=False)
    prompts = tagging.build_prompts(batched)
    if store:
        replies = tagging.store_replies(lambda p: tagging.call_labeller(p, labeller), prompts, store)
    else:
        replies = cut_lineage(tagging.call_labeller(prompts, labeller))   # one call per batch
    labels, bad = tagging.parse_replies(replies, settings.tags)
    quarantine = bad.select("batch_id", F.lit(None).cast("int").alias("idx"), "line", "reason").unionByName(
        tagging.out_of_range(batched, labels).select("batch_id", "idx", F.col("label").alias("line"), "reason"))
    aligned = tagging.align(batched, labels, replies)
    per_text = cut_lineage(aligned.join(uniq.select("ord", "text_key", "n_copies"), "ord")
                           .select("text_key", "label", "error", "n_copies"))
    labelled = corpus.join_back(docs.select("ord", "text"), per_text, ["label", "error"], "n_copies") \
                     .select("ord", "label", "error")
    return labelled, quarantine


@dataclass
class Clustering:
    assignments: dict[str, DataFrame]   # algo -> (id, cluster)
    metrics: DataFrame | None


def fit_predict(points: DataFrame, algo: str | None = None, k: int | None = None,
                settings: Settings = DEFAULTS) -> Clustering:
    """Cluster given vectors ``points(id, vec[, n])`` (C3, C5-C7) and score the result (Q-*).

    ``n`` says how many rows a point stands for (default 1); both algorithms
    and all scores count it, so the result is that of the repeated rows.
    """
    algos = cluster.resolve_algo(algo, settings.cluster)
    if "n" not in points.columns:
        points = points.withColumn("n", F.lit(1).cast("bigint"))
    n_points, n_rows = points.agg(F.count(F.lit(1)), F.sum("n")).first()
    assigned, metrics = {}, None

    def scored(df, name, space):
        nonlocal metrics
        m = quality.evaluate(df).withColumn("algo", F.lit(name)).withColumn("space", F.lit(space))
        metrics = m if metrics is None else metrics.unionByName(m)

    if "kmeans" in algos:
        given = points.select("id", "vec", "n")
        if settings.cluster.kmeans_method == "minibatch":
            res = minibatch.fit(given, k, settings.cluster, weight_col="n")
        elif settings.cluster.kmeans_method == "lloyd":
            res = cluster.kmeans(given, k, settings.cluster, weight_col="n", n_rows=n_points)
        else:
            raise ValueError(f"unknown k-means method {settings.cluster.kmeans_method!r}; lloyd or minibatch")
        if res is not None:
            assigned["kmeans"] = cut_lineage(res.assignments)
            scored(points.select("id", "vec", "n").join(assigned["kmeans"], "id"), "kmeans", "original")
    if "hdbscan" in algos:
        red, used = cluster.reduce_dims(points.select("id", "vec", "n"), None, settings.cluster, n_points)
        red = cut_lineage(red)
        assigned["hdbscan"] = cut_lineage(density.hdbscan(red, settings.cluster, weight_col="n"))
        scored(red.join(assigned["hdbscan"], "id"), "hdbscan", f"reduced_{used}")
    return Clustering(assigned, metrics)


def cluster_labels(labels: DataFrame, algo: str | None = None, k: int | None = None,
                   encoder=vectors.HashingEncoder, settings: Settings = DEFAULTS) -> tuple[str, DataFrame | None, DataFrame | None]:
    """Stored labels ``(ord, label)`` -> gate (C1), encode (E1), cluster, attach (C9), score (Q-*).

    Returns status, ``(algo, ord, cluster)`` for every row of ``labels`` (NULL
    where the label is NULL) and the metrics.
    """
    freq = cut_lineage(tagging.label_freq(labels.where(F.col("label").isNotNull())))
    n_labels, n_points = freq.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    if cluster.gate(n_labels, settings.tags) == "skipped":
        return "skipped", None, None
    # distinct labels get a dense id (distributed ordinal over the label text)
    keyed = with_ordinal(freq, ["label"], name="rn").select(
        (F.col("rn") - 1).alias("ord"), F.col("label").alias("text"), "n")
    enc = vectors.encode_with(keyed.select("ord", "text"), encoder)
    points = cut_lineage(keyed.join(enc, "ord").select(F.col("ord").alias("id"), "vec", "n", F.col("text").alias("label")))
    found = fit_predict(points.select("id", "vec", "n"), algo, k, settings)
    clusters = None
    for name, assignment in found.assignments.items():
        per = cut_lineage(assignment.join(points.select("id", "label", "n"), "id").select("label", "n", "cluster"))
        # a label may belong to most rows: hot labels are broadcast, not shuffled to one task
        part = lookup(labels.select("ord", "label"), per, "label", "n",
                      F.concat(F.lit("#"), F.col("ord").cast("string")), n_labels) \
            .select(F.lit(name).alias("algo"), "ord", "cluster")
        clusters = part if clusters is None else clusters.unionByName(part)
    return "clustered", clusters, found.metrics


def run_tag_job(docs: DataFrame, algo: str | None = None, k: int | None = None,
                labeller=tagging.rule_labeller, encoder=vectors.HashingEncoder,
                settings: Settings = DEFAULTS, store: str | None = None,
                registry: str | None = None) -> TagJob:
    """The tag job: label, then :func:`cluster_labels`; labels are written once.

    ``store`` names a folder for replies that later runs reuse. With
    ``registry`` (a folder) the labels of a corpus are kept under its
    fingerprint (P1, P2): a corpus that has been labelled there whole, without
    a failed call, is not labelled again.
    """
    spark = docs.sparkSession
    cluster.resolve_algo(algo, settings.cluster)
    path, kept = scratch_path(spark, "labels"), scratch_path(spark, "quarantine")
    known = False
    if registry:
        fp = cut_lineage(corpus.fingerprint(docs))
        table = tagging.read_store(spark, f"{registry}/corpora", "fingerprint string, n_docs bigint, registered_at timestamp")
        known = not table.join(fp.select("fingerprint"), "fingerprint").isEmpty()
        path, kept = (f"{registry}/{name}/{fp.first()['fingerprint']}" for name in ("labels", "quarantine"))
    if not known:
        labels, quarantine = label_texts(docs, labeller, settings, store=store)
        labels.write.mode("overwrite").parquet(path)
        quarantine.write.mode("overwrite").parquet(kept)
    labels = spark.read.schema("ord bigint, label string, error string").parquet(path)
    quarantine = spark.read.schema("batch_id bigint, idx int, line string, reason string").parquet(kept)
    if registry and not known and labels.where(F.col("error").isNotNull()).isEmpty():
        corpus.register_corpus(table, fp, f"{registry}/corpora")   # only once its labels are there
    n_samples = labels.count()
    status, clusters, metrics = cluster_labels(labels, algo, k, encoder, settings)
    return TagJob(status, n_samples, labels, clusters, metrics, quarantine)


def analyze_texts(docs: DataFrame, parse: DataFrame) -> DataFrame:
    """Text-analysis job: N1-N6 records for every text."""
    return annotate.analyze(docs, parse)


def texts_to_vectors(docs: DataFrame, word_vectors: DataFrame, dim: int, out: str | None = None,
                     settings: Settings = DEFAULTS) -> DataFrame:
    """E7 end to end: vocabulary, vector table, pooling, norm; written as one table."""
    toks = vocab.tokens(docs)
    v = vocab.build_vocab(toks, settings.vocab)
    vecs = vectors.sentence_vectors(docs, v, word_vectors, dim, settings.vocab, settings.vectors)
    if out:
        from textlab.sources.files import write_vectors
        write_vectors(docs.drop("text").join(vecs, "ord"), out)
    return vecs
