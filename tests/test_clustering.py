import time

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textlab.operators import cluster, density, quality


def _points(spark, xs, labels=None):
    rows = [(i, [float(v) for v in x], int(labels[i]) if labels is not None else 0) for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "id bigint, vec array<double>, cluster int")


def _np_metrics(x, y):
    m = y != -1
    x, y = x[m], y[m]
    ks = np.unique(y)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    s = []
    for i in range(len(x)):
        own = y == y[i]
        if own.sum() == 1:
            s.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, y == k].mean() for k in ks if k != y[i])
        s.append((b - a) / max(a, b))
    c = np.array([x[y == k].mean(0) for k in ks])
    g = x.mean(0)
    B = sum((y == k).sum() * ((c[j] - g) ** 2).sum() for j, k in enumerate(ks))
    W = sum(((x[y == k] - c[j]) ** 2).sum() for j, k in enumerate(ks))
    ch = B * (len(x) - len(ks)) / (W * (len(ks) - 1))
    sp = np.array([np.sqrt(((x[y == k] - c[j]) ** 2).sum(1)).mean() for j, k in enumerate(ks)])
    cd = np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1))
    np.fill_diagonal(cd, np.inf)
    db = np.mean(np.max((sp[:, None] + sp[None]) / cd, axis=1))
    return np.mean(s), ch, db


def test_f7_metrics(spark):
    pts = _points(spark, [(0, 0), (0, 1), (4, 0), (4, 1), (9, 9)], [0, 0, 1, 1, -1])
    r = quality.evaluate(pts).first()
    assert (r["n_samples"], r["n_in_clusters"], r["n_clusters"]) == (5, 4, 2)
    assert r["calinski"] == pytest.approx(32.0)
    assert r["davies_bouldin"] == pytest.approx(0.25)
    assert r["silhouette"] == pytest.approx(1 - 2 / (4 + math.sqrt(17)))


def test_f7_one_cluster_left_is_null(spark):
    pts = _points(spark, [(0, 0), (0, 1), (9, 9)], [0, 0, -1])
    r = quality.evaluate(pts).first()
    assert r["silhouette"] is None and r["calinski"] is None and r["davies_bouldin"] is None


def test_metrics_match_numpy_with_small_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 5))
    y = rng.integers(0, 4, size=120)
    y[y == 3] = -1
    y[0] = 7  # singleton cluster
    r = quality.evaluate(_points(spark, x, y), block_rows=25).first()
    sil, ch, db = _np_metrics(x, y)
    assert r["silhouette"] == pytest.approx(sil, abs=1e-9)
    assert r["calinski"] == pytest.approx(ch, rel=1e-9)
    assert r["davies_bouldin"] == pytest.approx(db, rel=1e-9)


def test_f9_k_clamp():
    assert cluster.clamp_k(0, 10) == 2
    assert cluster.clamp_k(99, 7) == 7
    assert cluster.clamp_k(5, 1) is None


def test_algo_names():
    assert cluster.resolve_algo("BOTH") == ("kmeans", "hdbscan")
    with pytest.raises(ValueError):
        cluster.resolve_algo("dbscan")


def test_kmeans_rows_go_to_nearest_centre(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (20, 3)), rng.normal(5, 0.1, (20, 3))])
    pts = _points(spark, x).select("id", "vec")
    res = cluster.kmeans(pts, k=2)
    cents = cluster.centres_from_model(spark, res.model)
    near = {r["id"]: r["center"] for r in cluster.nearest_centre(pts, cents).collect()}
    got = {r["id"]: r["cluster"] for r in res.assignments.collect()}
    assert near == got
    assert len(set(got[i] for i in range(20))) == 1 and got[0] != got[39]


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4))
    nn = density.knn(_points(spark, x), 5, block_rows=16).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for r in nn:
        order = np.lexsort((np.arange(60), d[r["id"]]))
        assert r["nbr"] == order[r["rank"] - 1]
        assert r["dist"] == pytest.approx(d[r["id"], r["nbr"]])


def _prim_weight(x, core):
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    w = np.maximum(d, np.maximum(core[:, None], core[None]))
    seen = np.zeros(n, bool)
    best = np.full(n, np.inf)
    best[0] = 0
    total = 0.0
    for _ in range(n):
        i = np.argmin(np.where(seen, np.inf, best))
        total += best[i]
        seen[i] = True
        best = np.minimum(best, w[i])
    return total


def test_mst_weight_matches_prim(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3))
    pts = _points(spark, x)
    core = density.core_distances(pts, 5, block_rows=30)
    edges = density.mst(pts, core, 80, block_rows=30).collect()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    core_np = np.sort(d, axis=1)[:, 4]
    assert len(edges) == 79
    assert sum(e["w"] for e in edges) == pytest.approx(_prim_weight(x, core_np))


def test_f8_density_two_lattices(spark):
    lat = [(i, j) for i in range(6) for j in range(5)]
    x = [(a, b) for a, b in lat] + [(a + 100, b) for a, b in lat]
    x += [(1000 + 1000 * k, 5000) for k in range(5)]
    lab = {r["id"]: r["cluster"] for r in density.hdbscan(_points(spark, x)).collect()}
    assert len(lab) == 65
    assert len({lab[i] for i in range(30)}) == 1 and lab[0] != -1
    assert len({lab[i] for i in range(30, 60)}) == 1 and lab[30] not in (-1, lab[0])
    assert all(lab[i] == -1 for i in range(60, 65))


def test_f8_too_few_rows_is_noise(spark):
    lab = density.hdbscan(_points(spark, [(0, 0), (1, 1), (2, 2), (3, 3)])).collect()
    assert [r["cluster"] for r in lab] == [-1] * 4


def test_f8_one_lattice_is_noise(spark):
    x = [(i, j) for i in range(6) for j in range(5)]
    lab = density.hdbscan(_points(spark, x)).collect()
    assert {r["cluster"] for r in lab} == {-1}


def test_colour_map(spark):
    pts = _points(spark, [(0, 0)] * 4, [5, 3, -1, 12])
    got = {r["cluster"]: r["color_idx"] for r in cluster.color_map(pts).collect()}
    assert got == {3: 0, 5: 1, 12: 2, -1: None}


def test_kmeans_independent_of_input_order(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 3))
    pts = _points(spark, x).select("id", "vec")
    a = {r["id"]: r["cluster"] for r in cluster.kmeans(pts, k=3).assignments.collect()}
    shuffled = pts.orderBy((pts.id * 7919) % 97).repartition(5)
    b = {r["id"]: r["cluster"] for r in cluster.kmeans(shuffled, k=3).assignments.collect()}
    assert a == b


def test_projection_budget_keeps_every_cluster(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 4))
    y = np.array([0] * 280 + [1] * 15 + [-1] * 5)
    pts = _points(spark, x, y)
    full = cluster.projection_2d(pts)
    assert full.count() == 300
    few = cluster.projection_2d(pts, budget=60).collect()
    by = {}
    for r in few:
        by[r["cluster"]] = by.get(r["cluster"], 0) + 1
    assert by.get(1) == 15 and by.get(-1) == 5 and 5 <= by.get(0, 0) <= 45


def _leaves_by_copying(pdf: pd.DataFrame, mcs: int) -> pd.DataFrame:
    """Leaf selection over MST edges ``(u, v, w)``; returns ``(id, cluster)``.

    Edges are merged level by level (all edges of one weight at once, so equal
    weights make one multiway merge). A level that joins two or more components
    of size >= mcs makes each of them a leaf unless it already contains such a
    merge; leaf members are the component's points at that moment.
    """
    if pdf.empty:
        return pd.DataFrame({"id": np.array([], dtype=np.int64), "cluster": np.array([], dtype=np.int32)})
    ids = np.unique(np.concatenate([pdf["u"].values, pdf["v"].values]).astype(np.int64))
    pos = {int(x): i for i, x in enumerate(ids)}
    n = len(ids)
    parent = np.arange(n)
    size = np.ones(n, dtype=np.int64)
    inner = np.zeros(n, dtype=bool)
    members: dict[int, list[int]] = {i: [i] for i in range(n)}

    def find(x: int) -> int:
        root = x
        while parent[root] != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    leaves: list[list[int]] = []
    e = pdf.sort_values(["w", "u", "v"], kind="stable")
    us = [pos[int(x)] for x in e["u"].values]
    vs = [pos[int(x)] for x in e["v"].values]
    ws = e["w"].values
    i = 0
    while i < len(ws):
        j = i
        while j < len(ws) and ws[j] == ws[i]:
            j += 1
        pairs = [(find(us[t]), find(vs[t])) for t in range(i, j)]
        olds = {r for p in pairs for r in p}
        big = {r for r in olds if size[r] >= mcs}
        snap = {r: list(members[r]) for r in big if not inner[r]}
        was_inner = {r: bool(inner[r]) for r in olds}
        for a, b in pairs:
            a, b = find(a), find(b)
            if a == b:
                continue
            if size[a] < size[b]:
                a, b = b, a
            parent[b] = a
            size[a] += size[b]
            members[a].extend(members.pop(b))
        groups: dict[int, list[int]] = {}
        for r in olds:
            groups.setdefault(find(r), []).append(r)
        for root, rs in groups.items():
            bigs = [r for r in rs if r in big]
            split = len(bigs) >= 2
            if split:
                leaves.extend(snap[r] for r in bigs if r in snap)
            inner[root] = split or any(was_inner[r] for r in rs)
        i = j
    label = np.full(n, -1, dtype=np.int64)
    for li, mem in enumerate(sorted(leaves, key=lambda m: int(ids[min(m)]))):
        label[np.asarray(mem, dtype=np.int64)] = li
    return pd.DataFrame({"id": ids, "cluster": label.astype(np.int32)})


@pytest.mark.parametrize("seed,walk", [(7, 0), (8, 0), (9, 1000)])
def test_leaves_match_reference(spark, seed, walk):
    rng = np.random.default_rng(seed)
    n = 120
    # random tree with repeated weights (ties exercise multiway levels)
    u = np.arange(1, n)
    v = np.array([rng.integers(0, i) for i in range(1, n)])
    w = rng.integers(1, 25, size=n - 1).astype(float)
    pdf = pd.DataFrame({"u": u.astype(np.int64), "v": v.astype(np.int64), "w": w})
    want = _leaves_by_copying(pdf, 10)
    edges = spark.createDataFrame(pdf)
    got = density.leaf_clusters(edges, 10, walk_edges=walk).toPandas()
    m = want.merge(got, on="id", suffixes=("_want", "_got"))
    assert len(m) == n
    assert (m["cluster_want"] == m["cluster_got"]).all()
    assert (m["cluster_want"] >= 0).any()


def test_merge_tree_is_linear_on_a_chain():
    n = 200_000
    edges = pd.DataFrame({"lu": np.arange(n), "lv": np.arange(1, n + 1), "w": np.arange(n) / 7.0})
    state = pd.DataFrame({"lab": np.arange(n + 1), "size": 1, "inner": False})
    t = time.perf_counter()
    out = density._merge_tree(edges, state, 10)
    assert time.perf_counter() - t < 60 and (out["size"] == n + 1).all() and (out["leaf"] == -1).all()


def test_weighted_density_equals_repeated_rows(spark):
    rng = np.random.default_rng(3)
    centres = np.array([[0, 0], [30, 0], [0, 40]])
    x = np.round(np.concatenate([c + rng.normal(size=(12, 2)) for c in centres]), 3)
    n = rng.integers(1, 4, len(x))
    rows = np.repeat(np.arange(len(x)), n)
    many = spark.createDataFrame([(i, [float(a) for a in x[r]]) for i, r in enumerate(rows)], "id long, vec array<double>")
    few = spark.createDataFrame([(i, [float(a) for a in x[i]], int(n[i])) for i in range(len(x))],
                                "id long, vec array<double>, n long")
    core = {r["id"]: r["core"] for r in density.core_distances(many, 5).collect()}
    weighted = {r["id"]: r["core"] for r in density.core_distances(few, 5, weight_col="n").collect()}
    assert all(core[i] == pytest.approx(weighted[r]) for i, r in enumerate(rows))
    a = {r["id"]: r["cluster"] for r in density.hdbscan(many).collect()}
    b = {r["id"]: r["cluster"] for r in density.hdbscan(few, weight_col="n").collect()}
    assert len(set(a.values()) - {-1}) == 3
    assert [a[i] >= 0 for i in range(len(rows))] == [b[r] >= 0 for r in rows]
    got = quality.evaluate(few.withColumn("cluster", F.floor(few.id / 12))).first()
    want = quality.evaluate(many.join(spark.createDataFrame([(i, int(r) // 12) for i, r in enumerate(rows)],
                                                            "id long, cluster long"), "id")).first()
    assert got["n_samples"] == want["n_samples"] == len(rows)
    for c in ("silhouette", "calinski", "davies_bouldin"):
        assert got[c] == pytest.approx(want[c])


def test_kmeans_does_not_depend_on_shuffle_partitions(spark):
    rng = np.random.default_rng(4)
    pts = _points(spark, rng.normal(size=(90, 3))).select("id", "vec")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in ("4", "17"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got.append({r["id"]: r["cluster"] for r in cluster.kmeans(pts, k=4).assignments.collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1]


def _clustered(rng, centres, each, spread, d=3):
    return np.concatenate([c + spread * rng.normal(size=(each, d)) for c in rng.uniform(-100, 100, (centres, d))])


def test_neighbours_visit_few_blocks_of_clustered_points(spark):
    x = np.concatenate([_clustered(np.random.default_rng(4), 24, 50, 1.0), np.zeros((40, 3))])
    n, seen = len(x), spark.sparkContext.accumulator(0)
    got = density.knn(_points(spark, x), 4, n, block_rows=50, evaluations=seen).collect()
    assert len(got) == 4 * n and seen.value < n * n / 4
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    order = np.stack([np.lexsort((np.arange(n), row)) for row in d])
    assert all(r["nbr"] == order[r["id"], r["rank"] - 1] for r in got)


def test_tree_of_clustered_points_searches_few_blocks(spark, monkeypatch):
    x = _clustered(np.random.default_rng(5), 12, 50, 1.0)
    n, pts, seen = len(x), _points(spark, x), spark.sparkContext.accumulator(0)
    core = density.core_distances(pts, 5, n, block_rows=50).checkpoint()
    rounds = []
    out_edges = density.cells.out_edges
    monkeypatch.setattr(density.cells, "out_edges", lambda *a: rounds.append(1) or out_edges(*a))
    edges = density.mst(pts, core, n, block_rows=50, evaluations=seen).collect()
    assert len(edges) == n - 1 and seen.value < len(rounds) * n * n / 3
    one = density.mst(pts, core, n).toPandas()
    assert sum(e["w"] for e in edges) == pytest.approx(one["w"].sum())


def test_hooks_and_joins_of_many_rows_equal_those_of_few(spark, monkeypatch):
    hooks = spark.createDataFrame([(i, i - 1) for i in range(1, 9)] + [(0, 1), (20, 21), (21, 20), (22, 20), (30, 99)],
                                  "comp long, to long")
    left = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, k long")
    right = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    got = []
    for few in (20_000, 0):
        monkeypatch.setattr(density, "FEW", few)
        roots = {r["comp"]: r["parent"] for r in density.roots_of(hooks).collect()}
        joined = density.spread_join(left, right, "k", density.F.xxhash64("id")).select("id", "k", "v")
        got.append((roots, sorted(map(tuple, joined.collect()), key=str)))
    assert got[0] == got[1] and got[0][0] == {**dict.fromkeys(range(9), 0), 20: 20, 21: 20, 22: 20, 30: 99}


def test_contracted_leaves_of_one_weight_and_of_weights(spark):
    lattice = pd.DataFrame({"u": np.arange(90), "v": np.arange(1, 91), "w": 1.0})
    assert {r["cluster"] for r in density.leaf_clusters(spark.createDataFrame(lattice), 10, walk_edges=0).collect()} == {-1}
    rng = np.random.default_rng(12)
    n = 60
    tree = pd.DataFrame({"u": np.arange(1, n), "v": [int(rng.integers(0, i)) for i in range(1, n)],
                         "w": rng.integers(1, 9, n - 1).astype(float)})
    edges, weights = spark.createDataFrame(tree), spark.createDataFrame([(i, 1 + i % 4) for i in range(n)], "id long, n long")
    a, b = ({r["id"]: r["cluster"] for r in density.leaf_clusters(edges, 12, walk, weights).collect()} for walk in (0, 1000))
    assert a == b and max(a.values()) > 0
