import zlib

import numpy as np
from helpers import empty_docs, odd_docs, rows_of

from textlab.llm import langid, quality, queries

SF = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    got = {r["doc_id"]: r for r in queries.op4_language(spark, SF).collect()}
    lang = dict(rows_of("documents", "doc_id, lang", SF))
    held = [i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r["held_out"]} == set(held) and len(got) == len(lang)
    assert np.mean([got[i]["lang_pred"] == lang[i] for i in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_of_odd_rows(spark):
    docs = odd_docs(spark)
    net = langid.learn(docs)
    assert set(net.langs) <= {"en", "de", "xx"}
    got = langid.predict(docs, net).collect()
    assert len(got) == docs.count()
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got if r["doc_id"] in (1, 2, 3))
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (4, 5)}) == 1
    assert langid.learn(empty_docs(spark)) is None
    assert langid.predict(empty_docs(spark), None).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}


def test_windows_cover_every_run_of_bytes():
    rng = np.random.default_rng(0)
    for n in (1, 2, 255, 256, 257, 509, 510, 3000):
        data = rng.integers(1, 255, n).astype(np.uint8)
        x, length = langid.windows(data, 0, n)
        step = langid.WINDOW - max(langid.WIDTHS) + 1
        assert all((x[k, :m] == data[k * step:k * step + m]).all() for k, m in enumerate(length))
        assert len(x) == 1 or (length[-1] >= max(langid.WIDTHS) and (len(x) - 1) * step + length[-1] == n)


def test_tables_ahead_give_the_same_answers():
    net = langid.Network(["a", "b"]).ready()
    x = np.random.default_rng(1).integers(0, 255, (20, langid.WINDOW)).astype(np.uint8)
    pooled, _ = net.pooled(x)
    z = np.maximum(pooled, 0) @ net.p["out"] + net.p["out_b"]
    want = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    assert np.allclose(net.log_probabilities(x), want, atol=1e-4)


def test_gradients():
    net = langid.Network(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 6, (4, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1])

    def loss():
        z = np.maximum(net.pooled(x)[0], 0) @ net.p["out"] + net.p["out_b"]
        return -np.mean((z - np.log(np.exp(z).sum(axis=1, keepdims=True)))[np.arange(4), y])

    g = net.gradients(x, y)
    for name, at in (("out", (3, 1)), ("w3", (1, 2, 5)), ("b2", (4,)), ("embed", (2, 3))):
        before = net.p[name][at]
        net.p[name][at] = before + 1e-5
        up = loss()
        net.p[name][at] = before - 1e-5
        assert abs((up - loss()) / 2e-5 - g[name][at]) < 1e-4
        net.p[name][at] = before


def test_quality_of_held_out_documents(spark):
    got = {r["doc_id"]: r for r in queries.op8_quality(spark, SF).collect()}
    label = dict(rows_of("labels", "doc_id, quality", SF))
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r["held_out"]} == set(held)
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())
    good, bad = ([got[i]["score"] for i in held if label.get(i) == v] for v in (1, 0))
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc >= 0.95 and np.mean([s >= 0.3 for s in good]) >= 0.98


def test_exact_votes():
    rng = np.random.default_rng(3)
    x, labels = rng.random((60, quality.TERMS)).astype(np.float32), rng.integers(0, 2, 60).astype(np.float32)
    model = quality.Model(x, labels)
    new = rng.random((5, quality.TERMS)).astype(np.float32)
    for a, s in zip(model.place(new), model.score(new), strict=True):
        cosine = np.maximum(model.vectors @ a, 0)
        best = np.argsort(-cosine)[:quality.NEIGHBOURS]
        w = cosine[best].astype(float) ** quality.SHARPEN
        assert abs(s - (w * labels[best]).sum() / w.sum()) < 1e-5


def test_quality_of_odd_rows(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(i, q) for i in range(1, 10) for q in ((0, 1) if i == 4 else (i % 2,))] + [(None, 1), (6, None)],
                                   "doc_id long, quality int")
    model = quality.learn(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in got if r["doc_id"] in (1, 2)} == {model.prior}
    nothing = quality.learn(empty_docs(spark), labels.limit(0))
    assert nothing.prior == 0.5 and quality.score(empty_docs(spark), nothing).count() == 0
    assert {r["score"] for r in quality.score(docs, nothing).collect()} == {0.5}


def test_language_of_repeated_ids_does_not_depend_on_their_order(spark):
    texts = {"a": "der Hund und die Katze sind im Haus ", "b": "the dog and the cat are at home now "}
    rows = [(i % 7, t * (1 + i % 3) + str(i), lang) for i in range(60) for lang, t in texts.items()]
    nets = []
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame(order, "doc_id long, text string, lang string").repartition(3)
        nets.append(langid.learn(frame))
    assert all((nets[0].p[k] == nets[1].p[k]).all() for k in nets[0].p)
