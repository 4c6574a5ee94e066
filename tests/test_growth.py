"""What a query reads, sends and computes grows with its input: forms that would have grown faster before."""

import numpy as np
from pyspark.sql import functions as F

from textlab.operators import blocks, quality, tagging, vectors
from textlab.plans import catalog
from textlab.session import scratch_path


def _documents(spark, tmp_path, n=65):
    rows = [(i, f"w{i % 7} w{i % 5} x{i}.", "en", "web", 9) for i in range(n)] + [(n, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint") \
        .write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tiled_distances_equal_explicit_ones():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(300, 5)) + 100, rng.normal(size=(1500, 5)) + 100
    y[7], y[8], y[9], y[10] = x[4], x[4] + 1e-9, np.nan, np.inf
    got = np.zeros((300, 1500))
    for i, j, d in blocks.Against(x).tiles(y):
        got[i:i + len(d), j:j + d.shape[1]] = np.sqrt(d)
    want = blocks.euclidean(x, y)
    assert np.allclose(got, want, rtol=1e-11, atol=0, equal_nan=True) and got[4, 7] == 0


def test_left_blocks_do_not_grow_with_the_rows(spark, monkeypatch):
    sizes = []
    real = quality.streamed_blocks
    monkeypatch.setattr(quality, "streamed_blocks", lambda pts, n, size, *a: sizes.append(size) or real(pts, n, size, *a))
    monkeypatch.setattr(quality, "LEFT_BLOCKS", 4)
    rng = np.random.default_rng(1)
    pts = spark.createDataFrame([(i, rng.normal(size=3).tolist(), i % 3) for i in range(1200)],
                                "id bigint, vec array<double>, cluster int")
    few = quality.silhouette(pts, block_rows=64).first()[0]
    monkeypatch.setattr(quality, "LEFT_BLOCKS", 1000)
    assert abs(few - quality.silhouette(pts, block_rows=64).first()[0]) < 1e-12 and sizes == [300, 64]


def test_pooling_sends_ids_not_vectors(spark):
    ids = spark.createDataFrame([(1, 0, 2), (1, 1, 3), (1, 2, 9), (2, None, None), (3, 0, 4), (4, 0, 2), (4, 1, 2)],
                                "ord bigint, pos int, id int")
    table = spark.createDataFrame([(2, [1.0, 2.0]), (3, [4.0, -2.0]), (4, [0.5, 0.0]), (4, [0.5, 3.0])],
                                  "id bigint, vec array<double>")   # an id with two vectors counts twice
    got = vectors.mean_pool(ids, table, 2)
    assert "MapInArrow" in _plan(got) and "Join" not in _plan(got)
    rows = lambda df: sorted((r["ord"], [round(x, 12) for x in r["vec"]], r["n_tokens"]) for r in df.collect())
    assert rows(got) == rows(vectors._pooled_by_join(ids, table, 2))
    assert rows(got)[1] == (2, [0.0, 0.0], 0) and rows(vectors.mean_pool(ids.where("ord < 0"), table, 2)) == []


def test_a_parse_read_once_is_not_written(spark, tmp_path):
    df = catalog.REGISTRY["subjects"](spark, _documents(spark, tmp_path))
    assert "LogicalRDD" not in _plan(df) and df.where("subject = 'w'").count() > 0


def test_prompts_are_made_once_and_only_those_asked_are_read_whole(spark, tmp_path):
    prompts = catalog._prompts(spark, _documents(spark, tmp_path))
    assert prompts.count() == 3 and "Aggregate" not in _plan(prompts)
    asked = []

    def run(todo):
        asked.append(_plan(todo).count("Aggregate"))     # nothing is made again on the way to the labeller
        return tagging.call_labeller(todo, lambda b, i, c: "1: x", retries=0)

    path = scratch_path(spark, "once")
    assert tagging.store_replies(run, prompts, path).where(F.col("reply") == "1: x").count() == 3
    assert tagging.store_replies(run, prompts, path).count() == 3 and asked == [0, 0]


def test_core_distances_keep_neighbours_in_their_task(spark, monkeypatch):
    from textlab.operators import cells, density
    rng = np.random.default_rng(5)
    vecs = np.concatenate([rng.normal(size=(150, 3)), rng.normal(size=(150, 3)) + 50, np.zeros((20, 3))])
    n = rng.integers(1, 4, len(vecs))
    n[0] = 30
    pts = spark.createDataFrame([(i, vecs[i].tolist(), int(n[i])) for i in range(len(vecs))],
                                "id bigint, vec array<double>, n bigint")
    d = np.sqrt(((vecs[:, None] - vecs[None]) ** 2).sum(axis=2))
    monkeypatch.setattr(cells, "neighbours", None)     # which gives each point k rows a block
    for k, kept in ((12, cells.KEPT), (12, 100), (400, 1000), (5000, cells.KEPT)):
        monkeypatch.setattr(cells, "KEPT", kept)
        want = []
        for i in range(len(vecs)):
            rest = np.delete(np.arange(len(vecs)), i)
            rest = rest[np.argsort(d[i, rest], kind="stable")]
            seen = n[i] - 1 + np.cumsum(n[rest]) - n[rest]
            want.append(d[i, rest][seen < k].max(initial=0.0))
        got = density.core_distances(pts, k, len(vecs), block_rows=16, weight_col="n").collect()
        assert len(got) == len(vecs) and all(abs(r["core"] - want[r["id"]]) < 1e-12 for r in got)


def _parse_rows(words, ord=1, sent=0, first=1):
    return [(ord, sent, first + i, w, "X", 0, "x") for i, w in enumerate(words)]


def test_phrases_are_found_in_words_that_lie_anywhere(spark, monkeypatch):
    from textlab.operators import annotate, phrases
    rng = np.random.default_rng(11)
    rows = []
    for o in range(12):
        for s in (0, 1, 63, 64, 200):
            rows += _parse_rows([f"w{x}" for x in rng.integers(0, 4, int(rng.integers(1, 45)))], o, s)
    rows += _parse_rows(["w1", "w 2", "", "w2", "w3"], 90) + _parse_rows(["w1", None, "w2"], 91) \
        + _parse_rows(["w1", "w2"], None, 3) + _parse_rows(["w1", "w2"], 92, None) + _parse_rows(["w2", "w1"], 93, 5, 7)
    rows.append((93, 5, None, "w3", "X", 0, "x"))           # before all others
    known = sorted({" ".join(f"w{x}" for x in rng.integers(0, 4, n)) for n in (1, 1, 2, 2, 2, 3, 3, 4) for _ in range(3)})
    long = [" ".join(r[3] for r in rows if r[:2] == (o, s)) for o in range(0, 12, 3) for s in (0, 63, 200)]
    known += [*long, "w 2", "w1 w 2", " w2", "w3 w2", "", "w1 w2 x" + " w1" * 60]
    pairs = [(p, "A") for p in known] + [(known[0], "B"), (known[0], "B"), (None, "N"), ("w3", None)]
    sentences = {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0)):
        sentences.setdefault(r[:2] if None not in r[:2] else (*r[:2], r[2]), []).append(r)
    want = [(*at[0][:2], run[0][2], p, t) for at in sentences.values() for p, t in pairs if p is not None
            for n in [p.count(" ") + 1] for i in range(len(at) - n + 1)
            for run in [at[i:i + n]] if [r[3] for r in run] == p.split(" ")]
    shuffled = [rows[i] for i in rng.permutation(len(rows))]
    for given in (rows, shuffled):
        toks = spark.createDataFrame(given, annotate.PARSE_SCHEMA).repartition(3) if given is shuffled \
            else spark.createDataFrame(given, annotate.PARSE_SCHEMA)
        gaz = spark.createDataFrame(pairs, "phrase string, type string")
        for limit in (phrases.BROADCAST_BYTES_LIMIT, 400, 0):     # all shipped, some, none
            monkeypatch.setattr(phrases, "BROADCAST_BYTES_LIMIT", limit)
            got = [tuple(r) for r in annotate.gazetteer_entities(toks, gaz).collect()]
            assert sorted(got, key=repr) == sorted(want, key=repr)
        monkeypatch.undo()


def test_phrases_write_words_once_and_exchange_only_what_the_filter_holds(spark, monkeypatch):
    from textlab.operators import annotate, common, phrases
    names = []
    monkeypatch.setattr(phrases, "written", lambda df, name: names.append(name) or common.written(df, name))
    toks = spark.createDataFrame([r for o in range(300) for r in _parse_rows([f"a{o}", "b", f"c{o % 7}", "d"], o)],
                                 annotate.PARSE_SCHEMA).coalesce(2)
    gaz = spark.createDataFrame([("a5 b c5", "P"), ("b", "P"), ("d e", "P")], "phrase string, type string")
    cuts = []
    monkeypatch.setattr(phrases, "cut_lineage", lambda df: cuts.append(common.cut_lineage(df)) or cuts[-1])
    found = annotate.gazetteer_entities(toks, gaz)
    assert sorted((r["ord"], r["text"]) for r in found.collect()) == sorted([(o, "b") for o in range(300)] + [(5, "a5 b c5")])
    assert names == ["sentences", "phrases"] and [c.count() for c in cuts] == [0]    # no checkpoint has words
    assert "Join" not in _plan(found)
    met = phrases._runs(spark.sparkContext.broadcast(phrases.phrase_filter(gaz.withColumnRenamed("phrase", "text"), 3)), frozenset([1, 2, 3]))
    assert phrases.sentence_words(toks).mapInArrow(met, "ord long, sent_id int, word_id int, text string").count() < 310


def test_a_parse_of_several_readers_is_no_checkpoint_of_rows(spark, tmp_path):
    df = catalog._parse(spark, _documents(spark, tmp_path), 2)[1]
    assert "LogicalRDD" not in _plan(df) and df.count() > 0
