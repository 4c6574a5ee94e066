"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Each runs over the whole driver tables (or data Spark derives from them).
Column names and types match the DuckDB oracles in :mod:`textlab.plans.oracles`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlab.functions import vectors as V
from textlab.operators import (annotate, classify, cluster, corpus, density, minibatch, phrases, quality, replies,
                               review, tagging, vectors, vocab)
from textlab.streaming import online
from textlab.operators.common import cut_lineage, written
from textlab.session import scratch_path
from textlab.sources import files
from textlab.sources import synthetic
from textlab.plans.tables import documents, embeddings, table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def _doc(df: DataFrame) -> DataFrame:
    return df.withColumnRenamed("ord", "doc_id")


# ---------------------------------------------------------------- vocabulary
@register("vocab_top")
def q_vocab_top(spark, sf_dir):
    """V3 on the whole corpus (flagship)."""
    toks = vocab.tokens(documents(spark, sf_dir))
    return vocab.build_vocab(toks)


@register("token_freq")
def q_token_freq(spark, sf_dir):
    """V2."""
    return vocab.token_freq(vocab.tokens(documents(spark, sf_dir)))


@register("tokens")
def q_tokens(spark, sf_dir):
    """V1 as flat rows."""
    return _doc(vocab.tokens(documents(spark, sf_dir)))


@register("encode_ids")
def q_encode_ids(spark, sf_dir):
    """V5; the id array is rendered as a comma list for the oracle compare."""
    docs = documents(spark, sf_dir)
    v = vocab.build_vocab(vocab.tokens(docs))
    enc = vocab.encode_ids(docs, v)
    return _doc(enc.select(
        "ord", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "n_tokens"))


@register("decode_ids")
def q_decode_ids(spark, sf_dir):
    """V4: ids of the first 64 tokens mapped back to words."""
    docs = documents(spark, sf_dir)
    v = vocab.build_vocab(vocab.tokens(docs))
    tid = vocab.token_ids(docs, v).where(F.col("pos").isNotNull()).select("ord", "pos", "id")
    return _doc(vocab.id_to_word(v, tid))


# ---------------------------------------------------------------- corpus
@register("corpus_fingerprint")
def q_fingerprint(spark, sf_dir):
    """P1 (tree digest)."""
    return corpus.fingerprint(documents(spark, sf_dir))


@register("corpus_changes")
def q_corpus_changes(spark, sf_dir):
    """Groups of 64 ids that changed since the stored level, after every 97th text was edited and the whole
    corpus appended again; the new level is made from the stored one, the edited ids and the appended rows."""
    docs, fanout = documents(spark, sf_dir).select("ord", "text"), 64
    path = scratch_path(spark, "digests")
    corpus.group_digests(docs, fanout).write.parquet(path)
    stored = spark.read.parquet(path)
    hit = F.col("ord") % 97 == 0
    now = docs.withColumn("text", F.when(hit, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    size = docs.agg(F.max("ord")).first()[0] or 0
    longer = now.unionByName(docs.withColumn("ord", F.col("ord") + (size + 1)))
    level = corpus.appended(corpus.edited(stored, now, docs.where(hit), fanout), longer, fanout)
    return corpus.changed_groups(stored, level, fanout)


@register("distinct_texts")
def q_distinct_texts(spark, sf_dir):
    """One row per distinct text."""
    return corpus.distinct_texts(documents(spark, sf_dir)).select(
        "text_key", F.col("rep_ord").alias("first_doc"), "n_copies")


@register("corpus_size")
def q_corpus_size(spark, sf_dir):
    """P3."""
    return corpus.corpus_size(documents(spark, sf_dir))


@register("stripped_texts")
def q_stripped(spark, sf_dir):
    """P4."""
    s = corpus.stripped(documents(spark, sf_dir))
    return _doc(s.select("ord", "text", F.length("text").alias("n_chars")))



# ---------------------------------------------------------------- cluster quality
def _round_metrics(df: DataFrame) -> DataFrame:
    return df.select("n_samples", "n_in_clusters", "n_clusters",
                     *[F.round(c, 6).alias(c) for c in ("silhouette", "calinski", "davies_bouldin")])


@register("cluster_metrics")
def q_cluster_metrics(spark, sf_dir):
    """Q-1..Q-4 on the given clustering of ``embeddings``."""
    return _round_metrics(quality.evaluate(embeddings(spark, sf_dir)))


@register("cluster_metrics_noise")
def q_cluster_metrics_noise(spark, sf_dir):
    """Q-1..Q-4 with label 0 treated as noise (-1), so noise rows are dropped first."""
    pts = embeddings(spark, sf_dir).withColumn(
        "cluster", F.when(F.col("cluster") == 0, F.lit(-1)).otherwise(F.col("cluster")))
    return _round_metrics(quality.evaluate(pts))


@register("cluster_sizes")
def q_cluster_sizes(spark, sf_dir):
    """C8."""
    return cluster.cluster_sizes(embeddings(spark, sf_dir))


# ---------------------------------------------------------------- tagging
def _tagged(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return tagging.tag(docs, tagging.rule_labeller, dense=False)


@register("label_batches")
def q_label_batches(spark, sf_dir):
    """L1 with a distributed ordinal (no single-partition window)."""
    b = tagging.assign_batches(documents(spark, sf_dir), dense=False)
    return _doc(b.select("ord", "batch_id", "idx"))


@register("label_prompts")
def q_label_prompts(spark, sf_dir):
    """L2: prompts alone, no labeller."""
    b = tagging.assign_batches(documents(spark, sf_dir), dense=False)
    return tagging.build_prompts(b).select("batch_id", "n_texts", "prompt")


def _failing_every_third(batch_id, items, chat):
    if batch_id % 3 == 0:
        raise TimeoutError("no answer")
    return tagging.rule_labeller(batch_id, items, chat)


@register("label_failures")
def q_label_failures(spark, sf_dir):
    """Calls of every third batch fail; no label is made up for their texts."""
    t = tagging.tag(documents(spark, sf_dir), _failing_every_third, dense=False)["aligned"]
    return _doc(t.select("ord", "batch_id", "label", "error"))


def _prompts(spark, sf_dir):
    """The prompts of all batches, written once: each run on a store reads them, and the result names their keys."""
    path = scratch_path(spark, "prompts")
    tagging.build_prompts(tagging.assign_batches(documents(spark, sf_dir), dense=False)).write.parquet(path)
    return spark.read.parquet(path)


@register("label_retry")
def q_label_retry(spark, sf_dir):
    """A second run on the same store asks again for what failed, and for nothing else."""
    prompts = _prompts(spark, sf_dir)
    path = scratch_path(spark, "retry")
    call = lambda f: lambda p: tagging.call_labeller(p, f, retries=0)
    tagging.store_replies(call(_failing_every_third), prompts, path)
    tagging.store_replies(call(lambda b, i, c: "again"), prompts, path)
    runs = spark.read.parquet(path).groupBy("prompt_key").agg(
        F.max("run").alias("runs"), F.count(F.when(F.col("error").isNotNull(), 1)).alias("n_failed"))
    keyed = prompts.select("batch_id", tagging.prompt_key().alias("prompt_key"))
    return keyed.join(runs, "prompt_key").select("batch_id", "runs", "n_failed")


@register("label_compacted")
def q_label_compacted(spark, sf_dir):
    """Three runs on one store (the third asks nothing), compacted after the second and the third:
    one row a prompt, no failure left, and of the replaced commits only those of the last compaction."""
    prompts = _prompts(spark, sf_dir)
    path = scratch_path(spark, "compacted")
    call = lambda f: lambda p: tagging.call_labeller(p, f, retries=0)
    tagging.store_replies(call(_failing_every_third), prompts, path)
    tagging.store_replies(call(lambda b, i, c: "again"), prompts, path)
    replies.compact(spark, path)
    tagging.store_replies(call(lambda b, i, c: "never"), prompts, path)
    replies.compact(spark, path)
    per = replies.stored(spark, path).groupBy("prompt_key").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("run").alias("run"), F.count("error").alias("n_failed"),
        F.count(F.when(F.col("reply") == "again", 1)).alias("n_again"))
    keyed = prompts.select("batch_id", tagging.prompt_key().alias("prompt_key"))
    return keyed.join(per, "prompt_key").drop("prompt_key") \
        .withColumn("n_commits", F.lit(len(replies.commits(spark, path))))


@register("label_array")
def q_label_array(spark, sf_dir):
    """The languages of the documents as one JSON array, read back in order."""
    path = scratch_path(spark, "label-array")
    langs = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(
        F.to_json(F.array_sort(F.collect_list(F.concat_ws(" ", "lang", "n")))).alias("value"))
    langs.coalesce(1).write.text(path)
    return files.read_label_array(spark, path)


@register("label_replies")
def q_label_replies(spark, sf_dir):
    """L3 (+L7 error column) with the deterministic rule labeller."""
    return _tagged(spark, sf_dir)["replies"]


@register("label_parse")
def q_label_parse(spark, sf_dir):
    """L4 + L5."""
    return _tagged(spark, sf_dir)["labels"]


@register("label_quarantine")
def q_label_quarantine(spark, sf_dir):
    """L5 rejects: lines whose index is not an integer."""
    return _tagged(spark, sf_dir)["quarantine"]


@register("label_align")
def q_label_align(spark, sf_dir):
    """Texts left join labels by key."""
    return _doc(_tagged(spark, sf_dir)["aligned"].select("ord", "batch_id", "idx", "label", "error"))


@register("label_validate")
def q_label_validate(spark, sf_dir):
    """L8 on every aligned label."""
    a = _tagged(spark, sf_dir)["aligned"].where(F.col("label").isNotNull())
    return _doc(tagging.validate(a).select("ord", "label", "n_words", "valid", "reason"))


@register("label_freq")
def q_label_freq(spark, sf_dir):
    """L9."""
    return tagging.label_freq(_tagged(spark, sf_dir)["aligned"])


# ---------------------------------------------------------------- vectors
WV_DIM = 8


def _flat(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.select(key, F.posexplode("vec").alias("j", "value")) \
             .select(key, "j", F.round("value", 6).alias("value"))


def _native_vectors(spark, sf_dir):
    docs = documents(spark, sf_dir)
    v = vocab.build_vocab(vocab.tokens(docs))
    wv = synthetic.derived_word_vectors(v.where(F.col("id") >= 2), WV_DIM)
    return docs, v, wv


@register("sentence_vectors")
def q_sentence_vectors(spark, sf_dir):
    """E7 (E2 mean pooling, E3 fill and [UNK], E6 norm) with derived word vectors."""
    docs, v, wv = _native_vectors(spark, sf_dir)
    sv = vectors.sentence_vectors(docs, v, wv, WV_DIM)
    return _flat(_doc(sv))


@register("sentence_vectors_300")
def q_sentence_vectors_300(spark, sf_dir):
    """E2/E7 at the default width of 300 (each component times 0.987654321, so that none lies halfway
    between two roundings)."""
    docs = documents(spark, sf_dir)
    v = vocab.build_vocab(vocab.tokens(docs))
    wv = synthetic.derived_word_vectors(v.where(F.col("id") >= 2), 300)
    sv = vectors.sentence_vectors(docs, v, wv, 300, normalize=False)
    each = _doc(sv.select("ord", F.posexplode("vec").alias("j", "value")))
    value = F.round(F.col("value") * 0.987654321, 6)
    return each.select("doc_id", "j", F.when(value == 0, F.lit(0.0)).otherwise(value).alias("value"))  # no -0.0


@register("vector_coverage")
def q_vector_coverage(spark, sf_dir):
    """V6."""
    _, v, wv = _native_vectors(spark, sf_dir)
    c = vocab.coverage(v, wv)
    return c.select("found", "needed", F.round("coverage", 6).alias("coverage"))


@register("padded_vectors")
def q_padded_vectors(spark, sf_dir):
    """E5: vectors zero-padded to 768 at the edge; width and norm per text."""
    docs, v, wv = _native_vectors(spark, sf_dir)
    sv = vectors.at_edge(vectors.sentence_vectors(docs, v, wv, WV_DIM))
    return _doc(sv.select("ord", F.size("vec").alias("width"),
                          F.round(V.l2_norm("vec"), 6).alias("norm")))


@register("normalized_embeddings")
def q_normalized_embeddings(spark, sf_dir):
    """E6 on the given embeddings."""
    e = vectors.normalized(embeddings(spark, sf_dir))
    return _flat(e, "id")


# ---------------------------------------------------------------- annotation
def _parse(spark, sf_dir, branches: int = 1):
    """Documents and their parse table. Where several ``branches`` read the parse it is written once, as a model
    step's output would be; one that is read once goes on to its reader, with the columns that this one needs."""
    docs = documents(spark, sf_dir)
    parse = synthetic.derived_parse(docs)
    return docs, (written(parse, "parse") if branches > 1 else parse)


@register("parse_tokens")
def q_parse_tokens(spark, sf_dir):
    """Derived parse table (input of N2-N5)."""
    return _doc(_parse(spark, sf_dir)[1])


@register("entities")
def q_entities(spark, sf_dir):
    """N1."""
    return _doc(annotate.entities(documents(spark, sf_dir)))


@register("subjects")
def q_subjects(spark, sf_dir):
    """N2."""
    return _doc(annotate.subjects(_parse(spark, sf_dir)[1]))


@register("adj_pairs")
def q_adj_pairs(spark, sf_dir):
    """N3."""
    return _doc(annotate.adj_pairs(_parse(spark, sf_dir, 2)[1]))


@register("keywords")
def q_keywords(spark, sf_dir):
    """N4."""
    return _doc(annotate.keywords(_parse(spark, sf_dir)[1]))


@register("main_event")
def q_main_event(spark, sf_dir):
    """N5 for every text (NULL when no sentence has a root)."""
    docs, toks = _parse(spark, sf_dir)
    return _doc(docs.select("ord").join(annotate.main_event(toks), "ord", "left"))


@register("text_analysis")
def q_text_analysis(spark, sf_dir):
    """N6 record, lists rendered as '|' strings for the compare."""
    docs, toks = _parse(spark, sf_dir)
    a = annotate.analyze(docs, toks)
    ent = F.transform("entities", lambda x: F.concat(x["text"], F.lit("/"), x["type"]))
    pairs = F.transform("adj_pairs", lambda x: F.concat(x["adjective"], F.lit(">"), x["subject"]))
    return _doc(a.select(
        "ord", F.size("entities").alias("n_entities"), F.array_join(ent, "|").alias("entities"),
        F.array_join("subjects", "|").alias("subjects"), F.array_join(pairs, "|").alias("adj_pairs"),
        "main_event", F.array_join("keywords", "|").alias("keywords")))


@register("parser_entities")
def q_parser_entities(spark, sf_dir):
    """N1/N6 with the parser's entities: the proper nouns of the parse."""
    docs, toks = _parse(spark, sf_dir, 2)
    order = Window.partitionBy("ord").orderBy("sent_id", "word_id")
    ents = toks.where(F.col("upos") == "PROPN").select(
        "ord", F.row_number().over(order).alias("ent_ord"), "text", F.lit("NAME").alias("type"))
    a = annotate.analyze(docs, toks, ents)
    return _doc(a.select("ord", F.size("entities").alias("n_entities"),
                         F.array_join(F.transform("entities", lambda x: x["text"]), "|").alias("entities")))


@register("gazetteer_entities")
def q_gazetteer_entities(spark, sf_dir):
    """N1 lookup: of every sentence the first 1 to 12 words (by its place) are a phrase, to be found everywhere."""
    _, toks = _parse(spark, sf_dir)
    sentences = phrases.sentence_words(toks)
    n = 1 + F.pmod(F.col("ord") * 7 + F.col("sent_id"), F.lit(12)).cast("int")
    gaz = sentences.where(F.size("words") >= n).select(
        F.array_join(F.slice("words", 1, n), " ").alias("phrase")).distinct()
    return _doc(annotate.gazetteer_entities(toks, gaz.withColumn("type", F.lit("PHRASE")), sentences))


# ---------------------------------------------------------------- clustering
def _label_centres(spark, sf_dir):
    return quality.centroids(embeddings(spark, sf_dir).where(F.col("cluster") != -1))


@register("nearest_centre")
def q_nearest_centre(spark, sf_dir):
    """C4 with fixed centres (the centroids of the given labels)."""
    pts = embeddings(spark, sf_dir)
    return cluster.nearest_centre(pts, _label_centres(spark, sf_dir))


@register("kmeans_assign")
def q_kmeans_assign(spark, sf_dir):
    """Spark ML k-means (k=5, seed 42) on the vectors - rows + invariants."""
    pts = embeddings(spark, sf_dir).select("id", "vec")
    res = cluster.kmeans(pts)
    return res.assignments


@register("minibatch_assign")
def q_minibatch_assign(spark, sf_dir):
    """C3 by mini-batches (k=5, seed 42): cluster of every vector."""
    return minibatch.fit(embeddings(spark, sf_dir).select("id", "vec")).assignments


STEP_CENTRES, STEP_BATCHES = 5, 8


@register("minibatch_steps")
def q_minibatch_steps(spark, sf_dir):
    """C3, the update: centres at the vectors of the smallest ids, moved by all vectors in eight batches by id."""
    pts = embeddings(spark, sf_dir).select("id", "vec").where(F.col("vec").isNotNull())
    first = pts.orderBy("id").limit(STEP_CENTRES).select(F.col("id"), V.to_double("vec").alias("centre")).collect()
    now = minibatch.Centres(np.array([r["centre"] for r in first], float), np.zeros(len(first)))
    dealt = cut_lineage(pts.withColumn("turn", F.pmod("id", F.lit(STEP_BATCHES))))
    for turn in range(STEP_BATCHES):
        now = minibatch.learn(now, dealt.where(F.col("turn") == turn))
    return now.table(spark).select("cluster", "weight", F.posexplode("centre").alias("j", "value")) \
        .withColumn("value", F.round("value", 6))


@register("minibatch_cost")
def q_minibatch_cost(spark, sf_dir):
    """Squared distances to the mini-batch centres are at most 2 % above those to Lloyd's, same k and seed."""
    pts = embeddings(spark, sf_dir).select("id", "vec")
    lloyd, mini = cluster.kmeans(pts), minibatch.fit(pts)
    given = minibatch.Centres(np.array(lloyd.model.clusterCenters()), np.zeros(lloyd.k))
    full, ours = minibatch.costs(pts, [given, mini.centres])
    return mini.assignments.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("cluster").alias("n_clusters")) \
        .withColumn("close", F.lit(bool(ours <= 1.02 * full)))


@register("kmeans_metrics")
def q_kmeans_metrics(spark, sf_dir):
    """Q-* on the k-means clustering (original space)."""
    pts = embeddings(spark, sf_dir).select("id", "vec")
    res = cluster.kmeans(pts)
    m = quality.evaluate(pts.join(res.assignments, "id"))
    return _round_metrics(m).withColumn("space", F.lit("original"))


@register("pca_reduce")
def q_pca_reduce(spark, sf_dir):
    """L2 normalise + PCA to min(50, d, n-1) dims (flat rows)."""
    red, _ = cluster.reduce_dims(embeddings(spark, sf_dir).select("id", "vec"))
    return red.select("id", F.posexplode("vec").alias("j", "value"))


@register("knn_graph")
def q_knn_graph(spark, sf_dir):
    """C6 exact k-NN with k = min_samples of the density step."""
    pts = embeddings(spark, sf_dir)
    n = pts.count()
    _, ms = density.density_params(n)
    nn = density.knn(pts, ms, n)
    return nn.select("id", "rank", "nbr", F.round("dist", 6).alias("dist"))


@register("core_distance")
def q_core_distance(spark, sf_dir):
    """Core distances of the density step."""
    pts = embeddings(spark, sf_dir)
    n = pts.count()
    _, ms = density.density_params(n)
    return density.core_distances(pts, ms, n).select("id", F.round("core", 6).alias("core"))


@register("hdbscan_leaves")
def q_hdbscan(spark, sf_dir):
    """C7 on the PCA-reduced vectors (rows + invariants)."""
    red, _ = cluster.reduce_dims(embeddings(spark, sf_dir).select("id", "vec"))
    return density.hdbscan(red)


@register("hdbscan_planted")
def q_hdbscan_planted(spark, sf_dir):
    """C6/C7 on planted points: the rows of a label form a lattice six wide, far from the others."""
    own = Window.partitionBy("cluster").orderBy("id")
    pts = embeddings(spark, sf_dir).withColumn("i", F.row_number().over(own) - 1)
    xy = F.array(F.col("cluster") * 100000.0 + F.col("i") % 6, F.floor(F.col("i") / 6).cast("double"))
    return density.hdbscan(pts.select("id", xy.alias("vec")))


@register("cluster_attach")
def q_cluster_attach(spark, sf_dir):
    """Every document with the cluster of its vector (NULL without one)."""
    docs = documents(spark, sf_dir)
    return _doc(cluster.attach(docs, embeddings(spark, sf_dir), "given"))


@register("cluster_colors")
def q_cluster_colors(spark, sf_dir):
    """G1 colour map with label 0 taken as noise."""
    pts = embeddings(spark, sf_dir).withColumn(
        "cluster", F.when(F.col("cluster") == 0, F.lit(-1)).otherwise(F.col("cluster")))
    return cluster.color_map(pts)


@register("projection_2d")
def q_projection_2d(spark, sf_dir):
    """G1 plot-ready 2-D points (rows)."""
    return cluster.projection_2d(embeddings(spark, sf_dir))


# ---------------------------------------------------------------- sources
@register("csv_roundtrip")
def q_csv_roundtrip(spark, sf_dir):
    """S3: documents written as CSV (quoted newlines) and read back in file order."""
    path = scratch_path(spark, "docs-csv") + ".csv"
    src = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    src.orderBy("doc_id").write.option("header", True).option("escape", '"').csv(path)
    back = files.read_texts(spark, path, "text", keep_all=True)
    return back.select(F.col("ord").alias("doc_id"), "text", "lang")


@register("csv_texts")
def q_csv_texts(spark, sf_dir):
    """The text column alone of a CSV, numbered in file order."""
    path = scratch_path(spark, "texts-csv") + ".csv"
    src = table(spark, sf_dir, "documents").select("lang", "text", "doc_id")
    src.orderBy("doc_id").write.option("header", True).option("escape", '"').csv(path)
    back = files.read_texts(spark, path, "text")
    return back.select(F.col("ord").alias("doc_id"), F.md5("text").alias("text_md5"))


@register("word_vector_file")
def q_word_vector_file(spark, sf_dir):
    """Derived word vectors written as a word-vector text file and read back
    (header line, a wrong-width line and a superseded duplicate included)."""
    docs = documents(spark, sf_dir)
    v = vocab.build_vocab(vocab.tokens(docs))
    wv = synthetic.derived_word_vectors(v.where(F.col("id") >= 2), WV_DIM)
    path = scratch_path(spark, "wordvec")
    header = spark.createDataFrame([(f"{WV_DIM} {WV_DIM}",)], "value string")
    noise = spark.createDataFrame([("the 1 2 3",), ("",)], "value string")
    # words whose md5 starts with '1' first appear with a stale all-zero vector
    stale = wv.where(F.substring(F.md5("word"), 1, 1) == "1") \
              .select("word", F.transform("vec", lambda x: x * 0).alias("vec"))
    lines = header.unionByName(noise).unionByName(synthetic.word_vector_lines(stale)) \
                  .unionByName(synthetic.word_vector_lines(wv))
    lines.write.text(path)   # part files keep union order: stale lines precede the real ones
    back = files.read_word_vectors(spark, path, v, WV_DIM)
    return back.select("word", F.posexplode("vec").alias("j", "value")) \
               .select("word", "j", F.round(F.col("value").cast("double"), 6).alias("value"))


# ---------------------------------------------------------------- promised features
def _quality_labels(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"), F.col("quality").alias("label"))


def _polarity(spark, sf_dir):
    docs = documents(spark, sf_dir)
    feats = classify.hashed_features(docs)
    pol = classify.train(feats, _quality_labels(spark, sf_dir))
    return classify.score(pol, feats)


@register("polarity_scores")
def q_polarity_scores(spark, sf_dir):
    """A1: logistic regression on hashed token features, scored on every text."""
    return _doc(_polarity(spark, sf_dir))


@register("polarity_confusion")
def q_polarity_confusion(spark, sf_dir):
    """A1 evaluation counts on the labelled texts."""
    return classify.confusion(_polarity(spark, sf_dir), _quality_labels(spark, sf_dir))


@register("polarity_three")
def q_polarity_three(spark, sf_dir):
    """A1 with three classes (toxic, low quality, the others), scored on every text."""
    label = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).otherwise(2)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ord"), label.alias("label"))
    feats = classify.hashed_features(documents(spark, sf_dir))
    return _doc(classify.score(classify.train(feats, labels), feats))


def _reviews(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    t1, t2 = F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-02 00:00:00").cast("timestamp")
    hostile = lab.where("toxic = 1").select(F.col("doc_id").alias("ord"), F.lit("hostile").alias("label"),
                                            F.lit("correct").alias("decision"), t2.alias("ts"))
    low = lab.where("quality = 0").select(F.col("doc_id").alias("ord"), F.lit("low effort").alias("label"),
                                          F.lit("correct").alias("decision"), t1.alias("ts"))
    ok = lab.where("quality = 1 AND toxic = 0").select(
        F.col("doc_id").alias("ord"), F.lit(None).cast("string").alias("label"),
        F.lit("confirm").alias("decision"), t1.alias("ts"))
    return hostile.unionByName(low).unionByName(ok)


def _overlay(spark, sf_dir):
    aligned = _tagged(spark, sf_dir)["aligned"]
    return review.overlay(aligned, _reviews(spark, sf_dir))


@register("review_overlay")
def q_review_overlay(spark, sf_dir):
    """A2: model labels with reviewer decisions derived from ``labels``."""
    return _doc(_overlay(spark, sf_dir))


@register("review_agreement")
def q_review_agreement(spark, sf_dir):
    """A2 agreement rate."""
    a = review.agreement(_overlay(spark, sf_dir))
    return a.select("n_reviewed", "n_agree", F.round("agreement", 6).alias("agreement"))


def _arriving(sf_dir: str) -> str:
    """The documents table as the source of a stream: a pattern, since the table may be one file or a folder of them."""
    return f"{sf_dir.rstrip('/')}/documents[.]parquet"


@register("online_vectors")
def q_online_vectors(spark, sf_dir):
    """A3: the documents table as a file stream, scored per micro-batch (availableNow)."""
    _, v, wv = _native_vectors(spark, sf_dir)
    out = online.run_online(spark, _arriving(sf_dir),
                            "doc_id bigint, text string, lang string, source string, n_chars bigint",
                            "doc_id", "text", v, wv, WV_DIM)
    return _flat(_doc(online.read_online(spark, out).select("ord", "vec")))


@register("online_centres")
def q_online_centres(spark, sf_dir):
    """A3: nearest centre of every arriving text; centres are the vectors of the first five documents."""
    docs, v, wv = _native_vectors(spark, sf_dir)
    table_ = cut_lineage(vectors.vector_table(v, wv, WV_DIM))
    given = vectors.sentence_vectors_from(docs.where(F.col("ord") < 5), v, table_, WV_DIM)
    centres = cut_lineage(given.select(F.col("ord").cast("int").alias("cluster"), F.col("vec").alias("centre")))
    out = online.run_online(spark, _arriving(sf_dir),
                            "doc_id bigint, text string, lang string, source string, n_chars bigint",
                            "doc_id", "text", v, wv, WV_DIM, centres=centres)
    return _doc(online.read_online(spark, out).select("ord", "center"))


@register("online_reuse")
def q_online_reuse(spark, sf_dir):
    """A3: turns of ``conversations`` arrive in four files; how many get a label, how many texts were labelled."""
    source, store = scratch_path(spark, "turns"), scratch_path(spark, "turn-labels")
    conv = table(spark, sf_dir, "conversations")
    conv.select((F.col("conv_id") * 1000000 + F.col("turn")).alias("ord"), "text") \
        .repartition(4, "ord").write.option("maxRecordsPerFile", 0).parquet(source)
    out = online.run_reusing(spark, source, "ord bigint, text string", "ord", "text", tagging.label_each,
                             store=store, max_files=1)
    made = spark.read.parquet(store).groupBy("label").agg(F.count(F.lit(1)).alias("n_made"))
    rows = online.read_online(spark, out).groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.join(made, rows["label"].eqNullSafe(made["label"]), "left") \
        .select(rows["label"], "n_rows", F.coalesce("n_made", F.lit(0)).cast("bigint").alias("n_made"))


@register("label_single")
def q_label_single(spark, sf_dir):
    """L2-L4/L7 single-text form over every turn of ``conversations``."""
    conv = table(spark, sf_dir, "conversations")
    keyed = conv.select((F.col("conv_id") * 1000000 + F.col("turn")).alias("ord"), "conv_id", "turn", "text")
    out = tagging.label_each(keyed.select("ord", "text"))
    return keyed.select("ord", "conv_id", "turn").join(out, "ord").drop("ord")


@register("label_store_roundtrip")
def q_label_store_roundtrip(spark, sf_dir):
    """Aligned labels written as JSON lines keyed by (run_id, batch_id, idx), read back;
    a second write of the same run adds nothing."""
    path = scratch_path(spark, "labels-json")
    aligned = _tagged(spark, sf_dir)["aligned"].select("ord", "batch_id", "idx", "label")
    files.write_labels(aligned, path, "r1")
    files.write_labels(aligned, path, "r1")
    back = spark.read.schema("ord bigint, batch_id bigint, idx int, label string, run_id string").json(path)
    return _doc(back.select("ord", "batch_id", "idx", "label"))


@register("vector_table_roundtrip")
def q_vector_table_roundtrip(spark, sf_dir):
    """Sentence vectors written as one Parquet table (ARRAY<FLOAT>) and read back."""
    docs, v, wv = _native_vectors(spark, sf_dir)
    sv = vectors.sentence_vectors(docs, v, wv, WV_DIM)
    path = scratch_path(spark, "vectors")
    files.write_vectors(sv, path)
    back = spark.read.parquet(path).select("ord", F.transform("embedding", lambda x: x.cast("double")).alias("vec"))
    return _flat(_doc(back))


@register("encoded_texts")
def q_encoded_texts(spark, sf_dir):
    """Injected encoder (default hashing encoder) over distinct texts, joined back."""
    enc = vectors.encode_with(documents(spark, sf_dir))
    return _flat(_doc(enc.select("ord", F.transform("vec", lambda x: x.cast("double")).alias("vec"))))


# ---------------------------------------------------------------- end to end
@register("tag_job_clusters")
def q_tag_job_clusters(spark, sf_dir):
    """Tag job: labels -> distinct labels -> vectors -> k-means + density -> every text's cluster."""
    from textlab.plans import pipeline
    job = pipeline.run_tag_job(documents(spark, sf_dir), algo="both")
    if job.clusters is None:
        return spark.createDataFrame([], "algo string, doc_id bigint, cluster int")
    return job.clusters.withColumnRenamed("ord", "doc_id")


@register("tag_job_coverage")
def q_tag_job_coverage(spark, sf_dir):
    """C9/Q-1: each algorithm has a row for every text, NULL where it has no label, and scores all labels."""
    from textlab.plans import pipeline
    job = pipeline.run_tag_job(documents(spark, sf_dir), algo="both")
    rows = job.clusters.groupBy("algo").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("cluster").alias("n_clustered"))
    return rows.join(job.metrics.select("algo", "n_samples"), "algo")


@register("kmeans_nearest")
def q_kmeans_nearest(spark, sf_dir):
    """C3/C4 invariant: rows whose k-means cluster isn't that of their nearest centre (none)."""
    pts = embeddings(spark, sf_dir).select("id", "vec")
    res = cluster.kmeans(pts)
    near = cluster.nearest_centre(pts, cluster.centres_from_model(spark, res.model))
    both = res.assignments.join(near, "id")
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("cluster") != F.col("center"), 1)).alias("n_wrong"))


@register("cluster_gate")
def q_cluster_gate(spark, sf_dir):
    """C1 for the documents of every language, source and both."""
    n = table(spark, sf_dir, "documents").cube("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("status", cluster.gate_status(F.col("n")))


@register("pca_correlation")
def q_pca_correlation(spark, sf_dir):
    """C5 invariant: reduced components don't correlate (largest of two, to 5 places: 0)."""
    red, used = cluster.reduce_dims(embeddings(spark, sf_dir).select("id", "vec"))
    m = Correlation.corr(red.select(array_to_vector("vec").alias("features")), "features").first()[0].toArray()
    largest = max((abs(m[i][j]) for i in range(used) for j in range(i)), default=0.0)
    return spark.createDataFrame([(used, float(round(largest, 5)))], "used int, largest double")


@register("polarity_totals")
def q_polarity_totals(spark, sf_dir):
    """A1: every labelled text is scored once; its totals by label."""
    return classify.confusion(_polarity(spark, sf_dir), _quality_labels(spark, sf_dir)) \
        .groupBy("label").agg(F.sum("n").alias("n"))


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
