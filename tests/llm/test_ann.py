import numpy as np
from helpers import SMALL, rows_of

from textlab.llm import ann, queries


def exact(ids, x, every=20, top=20):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        s = (x * x[i]).sum(axis=1)
        other = np.flatnonzero(np.arange(len(ids)) != i)
        best = other[np.lexsort((ids[other], -s[other]))][:top]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in best]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_and_scores(spark):
    rows = sorted(rows_of("embeddings", "vec_id, embedding"))
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got, want = result(queries.op7_nearest(spark, SMALL)), exact(ids, x)
    assert got.keys() == want.keys()
    found = np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want])
    assert found >= 0.9
    at = {int(i): k for k, i in enumerate(ids)}
    for q, hits in got.items():
        assert len(hits) == 20 and q not in {v for v, _ in hits}
        assert all(abs(s - (x[at[q]] * x[at[v]]).sum()) < 1e-12 for v, s in hits)
        assert hits == sorted(hits, key=lambda h: (-h[1], h[0]))


def test_clustered_vectors_of_many_lengths_in_split_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "PIECE", 150)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16)) * 3
    x = (centres[rng.integers(0, 30, 1200)] + rng.normal(size=(1200, 16)) * 0.3) * rng.uniform(0.5, 2, (1200, 1))
    x[200:500] = x[200]  # a third of the rows are one vector
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got, want = result(ann.search(rows)), exact(np.arange(1200), x)
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.9
    assert [v for v, _ in got[220]] == [v for v, _ in want[220]]  # ties to the smaller ids


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
            (7, []), (None, [1.0, 1.0]), (20, [0.0, 1.0]), (20, [0.0, 1.0]), (40, [1.0, 2.0, 3.0]), (8, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = result(ann.search(df))
    assert got == {0: [(1, 0.5), (20, 0.0), (8, -1.0)], 20: [(1, 0.5), (0, 0.0), (8, 0.0)]}
    assert ann.search(df.limit(0)).count() == 0
