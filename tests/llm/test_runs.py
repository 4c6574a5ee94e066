import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from helpers import SMALL, empty_docs, odd_docs, rows_of

from textlab.llm import queries, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """Every run by comparing the words of every distance; the least period is that which comes first."""
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(
                    words[i:i + length - p] == words[i + p:i + length] for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def without_repeats(words, found):
    gone = {k for s, length, q in found for k in range(s + q, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def periodic_text(rng):
    words = []
    while len(words) < rng.choice([0, 5, 40, 300, 900]):
        kind = rng.randrange(4)
        alphabet = rng.choice(["ab", "abc", "abcdefghijklmnop"])
        unit = [rng.choice(alphabet) for _ in range(rng.choice([1, 1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 23, 31, 32, 40, 64, 90]))]
        if kind == 0:
            words += unit
        elif kind == 1:
            words += (unit * 12)[:int(len(unit) * rng.choice([2, 3.4, 3.99, 4, 4.01, 5.3, 9]))]
        elif kind == 2:  # a period of periods
            words += (unit[:3] * 4 + unit) * rng.choice([3, 4, 6])
        else:
            words += [rng.choice("ab") for _ in range(rng.randrange(30))]
    return " ".join(words)


@pytest.mark.parametrize("words", [runs.WORDS, 50])
def test_same_as_brute_force(monkeypatch, words):
    monkeypatch.setattr(runs, "WORDS", words)
    rng = random.Random(11)
    texts = [periodic_text(rng) for _ in range(250)]
    found, split = runs.find([t.encode() for t in texts])
    periods = set()
    for t, rows, w in zip(texts, found, split, strict=True):
        want = brute(t.split())
        assert [tuple(r) for r in rows.tolist()] == want
        assert runs.collapsed(w, rows).decode() == without_repeats(t.split(), want)
        periods |= {q for _, _, q in want}
    assert max(periods) >= 64 and len(periods) > 20


def test_strings_full_of_repeats():
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 600:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    cubes = "".join("aab" * 5 + "ab" * (5 + i % 3) for i in range(40))
    for t in (fibonacci[-1], "ab" * 500, "a" * 700, "a" * 300 + "b" + "a" * 300, ("a" * 9 + "b") * 60, cubes):
        words = list(t)
        assert [tuple(r) for r in runs.find([" ".join(words).encode()])[0][0].tolist()] == brute(words)


def planted(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_query_same_as_brute_force(spark):
    got = {r["doc_id"]: r for r in queries.op11_runs(spark, SMALL).collect()}
    rows = rows_of("documents", "doc_id, text")
    assert len(got) == len(rows)
    n = 0
    for doc, text in rows:
        if len(text) > 6000:
            continue
        words, r = planted(doc, text), got[doc]
        found = brute(words)
        n += bool(found)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert r["n_runs"] == len(found)
        assert r["runs_sha256"] == digest("".join(f"{a},{b},{c}\n" for a, b, c in found))
        assert r["collapsed_sha256"] == digest(without_repeats(words, found))
        best = None
        for f in found:
            if best is None or f[1] * best[2] > best[1] * f[2]:
                best = f
        assert (r["start"], r["length"], r["period"]) == (best or (None,) * 3)
        assert r["exponent_milli"] == (best and 1000 * best[1] // best[2])
    assert n > 5


def test_odd_rows(spark):
    docs = odd_docs(spark).selectExpr("*", "'r' as RUNS", "1 as collapsed")
    rows = runs.detect(docs).collect()
    assert len(rows) == docs.count() and "RUNS" not in rows[0].asDict()
    for r in rows:
        words = WORD.findall(r["text"] or "")
        if len(words) < 100:
            assert (r["runs"], r["collapsed"]) == ([], " ".join(words))
        else:  # 97 and 13 have no common factor: the text repeats after 1261 words
            assert [tuple(x) for x in r["runs"]] == [(0, 30_000, 97 * 13)]
            assert r["collapsed"] == " ".join(words[:97 * 13])
    assert runs.detect(empty_docs(spark)).count() == 0


def test_slices_of_one_window_minimum():
    rng = np.random.default_rng(2)
    for n, width in ((1, 3), (10, 4), (37, 9), (64, 64), (5, 70)):
        v = rng.integers(0, 50, n).astype(np.uint64)
        assert runs.window_min(v, width).tolist() == [min(v[i:i + width]) for i in range(n)]
