import zlib
from collections import defaultdict

import numpy as np
from helpers import SMALL, empty_docs, odd_docs, rows_of

from textlab.llm import queries, sharding


def test_differencing_is_tight():
    rng = np.random.default_rng(0)
    sizes = rng.lognormal(8, 1.2, 3000).astype(int)
    at = sharding.difference(sizes, 8)
    sums = np.bincount(at, sizes, 8)
    assert sums.max() - sums.min() <= 8
    assert sharding.difference(np.array([5]), 8).tolist() == [0]
    assert sorted(sharding.difference(np.array([9, 9, 9]), 3).tolist()) == [0, 1, 2]


def test_query(spark):
    got = queries.op5_sharding(spark, SMALL).collect()
    texts = dict(rows_of("documents", "doc_id, text"))
    assert len(got) == len(texts)
    shards, place = defaultdict(list), defaultdict(set)
    for r in got:
        data = texts[r["doc_id"]].encode()
        assert r["size"] == len(data) + 1 and r["text_crc32"] == zlib.crc32(data) and r["grown_shard"] is None
        shards[r["shard"]].append(r)
        place[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in place.values())
    assert all(sorted(r["slot"] for r in rows) == list(range(len(rows))) for rows in shards.values())
    sums = [sum(r["size"] for r in rows) for rows in shards.values()]
    assert len(sums) == 8 and max(sums) - min(sums) <= 0.01 * sum(sums) / 8


def test_levels_of_buckets(spark):
    rng = np.random.default_rng(1)
    rows = [(f"k{i}", int(s), 1) for i, s in enumerate(rng.lognormal(6, 1, 1500))] + [("huge", 10**6, 5)]
    groups = spark.createDataFrame(rows, "key string, size long, n long")
    got = {r["key"]: r["shard"] for r in sharding.assign(groups, 8, fine=60, bucket=50).collect()}
    assert len(got) == 1501
    sums = np.bincount([got[k] for k, _, _ in rows], [s for _, s, _ in rows], 8)
    assert sums.max() == 10**6  # nothing joins the group that is larger than a fair share
    assert np.ptp(np.sort(sums)[:-1]) <= 0.05 * np.sort(sums)[:-1].mean()


def test_odd_rows(spark):
    got = sharding.shard(odd_docs(spark)).collect()
    assert len(got) == odd_docs(spark).count()
    assert {r["size"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert len({r["shard"] for r in got if r["doc_id"] in (4, 5)}) == 1
    assert sharding.shard(empty_docs(spark)).count() == 0
