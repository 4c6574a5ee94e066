import numpy as np
import xxhash
from helpers import SMALL, empty_docs, odd_docs, rows_of

from textlab.llm import queries, simhash


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    k = min(4, len(w))
    h = [xxhash.xxh64(b" ".join(w[i:i + k]), seed=42).intdigest() for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_classes(fps, max_bits=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(f ^ fps[i + 1:]) <= max_bits) + i + 1:
            root[find(i)] = find(int(j))
    return [find(i) for i in range(len(fps))]


def test_query_against_brute_force(spark):
    rows = rows_of("documents", "doc_id, text")
    fps = np.array([slow_fingerprint(t) for _, t in rows], np.uint64)
    root = slow_classes(fps)
    low = {}
    for (i, _), r in zip(rows, root, strict=True):
        low[r] = min(low.get(r, i), i)
    want = {(i, f"{int(f):016x}", low[r]) for (i, _), f, r in zip(rows, fps, root, strict=True)}
    assert {tuple(r) for r in queries.op10_simhash(spark, SMALL).collect()} == want
    assert any(i != c for i, _, c in want)


def test_links_of_chains_and_crowds(spark):
    rng = np.random.default_rng(2)
    fps = list(rng.integers(0, 2**63, 1500, dtype=np.uint64))
    for _ in range(4):  # chains, of which only neighbours are near
        x = int(rng.integers(0, 2**63))
        for _ in range(30):
            for b in rng.choice(64, 4, replace=False):
                x ^= 1 << int(b)
            fps.append(np.uint64(x))
    centre = int(rng.integers(0, 2**63))
    for _ in range(300):  # a crowd
        x = centre
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            x ^= 1 << int(b)
        fps.append(np.uint64(x))
    fps = np.unique(np.array(fps, np.uint64))
    root = slow_classes(fps)
    rows = spark.createDataFrame([(i, int(f)) for i, f in enumerate(fps.view(np.int64))], "doc_id long, fingerprint long")
    got = {r["doc_id"]: r["component_id"] for r in simhash.classes(rows).collect()}
    low = {}
    for i, r in enumerate(root):
        low.setdefault(r, i)
    assert got == {i: low[r] for i, r in enumerate(root)}


def test_bound_is_a_bound():
    rng = np.random.default_rng(4)
    a, b = (rng.integers(0, 2**63, 5000, dtype=np.uint64) for _ in range(2))
    counts = lambda x: np.stack([np.bitwise_count((x >> np.uint64(2 * i)) & np.uint64(3)) for i in range(32)]).astype(int)
    manhattan = np.abs(counts(a) - counts(b)).sum(axis=0)
    assert (np.bitwise_count(simhash._thermometer(a) ^ simhash._thermometer(b)) == manhattan).all()
    assert (manhattan <= np.bitwise_count(a ^ b)).all()


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[2] == by[3] == by[1] == 1 and by[5] == 4 and by[6] == 6
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {1, None}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({1, 4, 6, 7, 8, 9}) and ids.count(None) == 1
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0 and simhash.keep_one(empty_docs(spark)).count() == 0


def test_one_row_of_each_component(spark):
    rng = np.random.default_rng(6)
    new = lambda: " ".join(f"w{x}" for x in rng.integers(0, 10**6, 60))
    a, b, c, d = new(), new(), new(), new()
    apart = np.array([slow_fingerprint(t) for t in (a, b, c, d)], np.uint64)
    assert all(np.bitwise_count(apart[i] ^ apart[i + 1:]).min() > 4 for i in range(3))

    def kept(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        return sorted(tuple(r) for r in simhash.keep_one(docs).collect())

    # one id that is the smallest of several components
    assert kept([(5, a), (9, a), (5, b), (12, b)]) == sorted([(5, a), (5, b)])
    assert kept([(0, a), (0, b), (0, c), (0, c), (7, d)]) == sorted([(0, a), (0, b), (0, c), (7, d)])
    # a component of several fingerprints, of which no row has an id
    words, near = a.split(), None
    for i in range(60):
        for x in range(20):
            t = " ".join([*words[:i], f"v{x}", *words[i + 1:]])
            if 0 < int(np.bitwise_count(np.uint64(slow_fingerprint(t)) ^ apart[0])) <= 4:
                near = t
    assert near
    assert len(kept([(None, a), (None, near), (None, near)])) == 1
