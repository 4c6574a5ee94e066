"""The queries of operators 4, 5 and 8 against plain, slow versions of their methods on a small table."""

import hashlib
import math

import numpy as np
from helpers import SMALL, rows_of

from textlab.llm import langid, quality, queries, sharding
from textlab.llm.common import table


def _slow_language(net, text):
    data = text.encode()
    step = langid.WINDOW - max(langid.WIDTHS) + 1
    p = {k: v.astype(float) for k, v in net.p.items()}
    whole, weight, begin = np.zeros(len(net.langs)), 0, 0
    while True:
        piece = data[begin:begin + langid.WINDOW]
        x = p["embed"][list(piece) + [0] * (langid.WINDOW - len(piece))]
        hidden = []
        for w in langid.WIDTHS:
            answers = [np.tensordot(x[i:i + w], p[f"w{w}"], 2) + p[f"b{w}"] for i in range(langid.WINDOW - w + 1)]
            hidden.extend(max(0.0, v) for v in np.max(answers, axis=0))
        z = np.array(hidden) @ p["out"] + p["out_b"]
        whole += (z - z.max() - math.log(np.exp(z - z.max()).sum())) * len(piece)
        weight += len(piece)
        if begin + langid.WINDOW >= len(data):
            break
        begin += step
    mean = np.exp(whole / weight - (whole / weight).max())
    return mean / mean.sum()


def test_language_query(spark):
    net = langid.learn(table(spark, SMALL, "documents").select("doc_id", "text", "lang"))
    got = {r["doc_id"]: r for r in queries.op4_language(spark, SMALL).collect()}
    texts = dict(rows_of("documents", "doc_id, text"))
    assert set(got) == set(texts)
    for i, text in texts.items():
        if not text or not any(c.isalpha() for c in text):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        p = _slow_language(net, text)
        assert abs(got[i]["score"] - p.max()) < 1e-4
        assert got[i]["lang_pred"] == net.langs[int(p.argmax())] or np.sort(p)[-1] - np.sort(p)[-2] < 1e-4


def _slow_differencing(sizes, shards):
    """Lists of members in each shard, largest sum first."""
    parts = [[(s, [i])] + [(0, [])] * (shards - 1) for i, s in enumerate(sizes)]
    parts = list(enumerate(parts))          # numbered in the order of their making, which breaks ties
    made = len(parts)
    while len(parts) > 1:
        parts.sort(key=lambda part: (-(part[1][0][0] - part[1][-1][0]), part[0]))
        (_, a), (_, b) = parts[:2]
        both = [(x + y, m + n) for (x, m), (y, n) in zip(a, reversed(b))]
        parts = parts[2:] + [(made, sorted(both, key=lambda sm: -sm[0]))]
        made += 1
    return [members for _, members in parts[0][1]]


def test_sharding_query(spark):
    texts = dict(rows_of("documents", "doc_id, text"))
    groups = {}
    for i, text in texts.items():
        data = (text or "").encode()
        groups.setdefault(hashlib.md5(data).hexdigest() + str(len(data)), []).append((i, len(data) + 1))
    order = sorted(groups, key=lambda k: (-sum(s for _, s in groups[k]), k))
    placed = _slow_differencing([sum(s for _, s in groups[k]) for k in order], 8)
    want = {i: shard for shard, members in enumerate(placed) for g in members for i, _ in groups[order[g]]}
    assert {r["doc_id"]: r["shard"] for r in queries.op5_sharding(spark, SMALL).collect()} == want


def test_differencing_of_ties():
    rng = np.random.default_rng(5)
    for shards in (2, 3, 8):
        for n in (2, 7, 60):
            sizes = np.sort(rng.integers(1, 6, n))[::-1]
            got = sharding.difference(sizes, shards)
            want = {i: s for s, members in enumerate(_slow_differencing(sizes.tolist(), shards)) for i in members}
            assert got.tolist() == [want[i] for i in range(n)]


def _slow_terms(text):
    data = text.encode()
    out = np.zeros(quality.TERMS)
    if len(data) < 3:
        return out
    kind = [next((k for k, c in enumerate(quality.CLASSES) if byte in c), len(quality.CLASSES)) for byte in data]
    first = quality.KINDS**3
    for i in range(len(data) - 2):
        out[(kind[i] * quality.KINDS + kind[i + 1]) * quality.KINDS + kind[i + 2]] += 1 / (len(data) - 2)
    for a, b in zip(data, data[1:]):
        out[first + ((a * 256 + b) * 40503 // 16) % quality.PAIRS] += 1 / (len(data) - 1)
    out = np.sqrt(out)
    out[:first] *= quality.BLOCKS[0]
    out[first:] *= quality.BLOCKS[1]
    words, lines = text.split(), [x for x in text.split("\n") if x]
    same = sum(a == b for a, b in zip(words, words[1:])) / max(1, len(words) - 1)
    shares = [same, 1 - len(set(words)) / max(1, len(words)), 1 - len(set(lines)) / max(1, len(lines)),
              min(1.0, 2 * len(words) / len(data))]
    for k, share in enumerate(shares):
        step = sum(end < share for end in quality.STEPS)
        out[first + quality.PAIRS + k * (len(quality.STEPS) + 1) + step] = quality.BLOCKS[2] / math.sqrt(quality.SHARES)
    return out


def test_quality_query(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    model = quality.learn(docs, table(spark, SMALL, "labels").select("doc_id", "quality"))
    got = {r["doc_id"]: r["score"] for r in queries.op8_quality(spark, SMALL).collect()}
    texts = dict(rows_of("documents", "doc_id, text"))
    assert set(got) == set(texts)
    for i, text in texts.items():
        x = _slow_terms(text or "")
        if not x.any():
            assert got[i] == model.prior
            continue
        at = (x * model.idf) @ model.projection.astype(float)
        cosine = np.maximum(model.vectors.astype(float) @ (at / np.linalg.norm(at)), 0)
        least = np.sort(cosine)[-quality.NEIGHBOURS]
        sure = np.flatnonzero(cosine > least + 1e-5)
        tied = np.flatnonzero(np.abs(cosine - least) <= 1e-5)     # any of equal neighbours may vote
        tied = tied[np.argsort(model.labels[tied], kind="stable")]
        free = quality.NEIGHBOURS - len(sure)
        ends = []
        for chosen in (tied[:free], tied[len(tied) - free:]):
            voters = np.concatenate([sure, chosen])
            w = cosine[voters] ** quality.SHARPEN
            ends.append((w * model.labels[voters]).sum() / w.sum())
        assert ends[0] - 1e-3 <= got[i] <= ends[1] + 1e-3
