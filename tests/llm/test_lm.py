import math
from collections import Counter

import pytest
from helpers import empty_docs, odd_docs, rows_of

from textlab.llm import lm


def brute(texts):
    runs = [[b"<s>", *w, b"</s>"] if (w := (t or "").encode().lower().split()) else [] for t in texts]
    word, pair = Counter(w for r in runs for w in r[1:]), Counter(p for r in runs for p in zip(r, r[1:]))
    word[b"<s>"], total = word[b"</s>"], sum(word.values())
    out = []
    for r in runs:
        s = [math.log(pair[v, w] / word[v]) if pair[v, w] >= lm.LEAST else math.log(lm.BACKOFF * word[w] / total)
             for v, w in zip(r, r[1:])]
        out.append(math.fsum(s) / len(s) if s else None)
    return out


@pytest.mark.parametrize("hot_part, part", [(lm.HOT, lm.PART), (50, 3000), (10**9, 20_000)])
def test_scores(spark, hot_part, part):
    rows = rows_of("documents", "doc_id, text")
    got = {r["doc_id"]: r["score"] for r in lm.score(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3), hot_part=hot_part, part=part).collect()}
    assert len(got) == len(rows)
    for (i, _), want in zip(rows, brute([t for _, t in rows]), strict=True):
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_odd_rows(spark):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs(spark).collect()]
    got = sorted((str(r["doc_id"]), r["n_words"], round(r["score"] or 0, 9)) for r in lm.score(odd_docs(spark)).collect())
    n = [len((t or "").encode().split()) for _, t in rows]
    want = sorted((str(i), k, round(s or 0, 9)) for (i, _), k, s in zip(rows, n, brute([t for _, t in rows]), strict=True))
    assert got == want
    assert lm.score(empty_docs(spark)).count() == 0


def test_chunks_and_blocks(spark, monkeypatch):
    import numpy as np
    text = " ".join(f"w{i % 7}" * (i % 3 + 1) for i in range(5000)).encode()
    data = np.frombuffer(text, np.uint8)
    whole = lm.words(data)
    monkeypatch.setattr(lm, "CHUNK", 100)
    parts = lm.words(data)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all() and len(set(whole[0].tolist())) == 21
