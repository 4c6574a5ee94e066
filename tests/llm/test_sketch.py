import hashlib

import numpy as np
import xxhash
from helpers import SMALL, empty_docs, odd_docs, rows_of
from pyspark.sql import functions as F

from textlab.llm import queries, sketch


def xx(data, seed=42):
    return xxhash.xxh64(data, seed=seed).intdigest()


def slow_grams(text):
    """Shingle hashes with Spark's hash functions said in Python: a run of longs is hashed one by one, as seeds."""
    words = text.lower().split()
    if not words:
        return []
    h = [xx(w.encode()) for w in words]
    grams = []
    for i in range(max(1, len(h) - sketch.SHINGLE + 1)):
        seed = 42
        for x in h[i:i + sketch.SHINGLE]:
            seed = xx(np.uint64(x).tobytes(), seed)
        grams.append(seed >> 16)
    return grams


def slow_sketch(text):
    grams = slow_grams(text)
    return sorted({g for g in grams if g < 2**48 // sketch.PART} | {min(grams)}) if grams else []


def likeness(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def test_query_against_brute_force(spark):
    rows = sorted(rows_of("documents", "doc_id, text"), reverse=True)
    got = {r["doc_id"]: r for r in queries.op6_sketch(spark, SMALL).collect()}
    assert len(got) == len(rows)
    errors = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        a, b, c = slow_sketch(t), slow_sketch(edited), slow_sketch(after)
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == "".join(f"{x:012x}" for x in a)
        assert r["edited_fingerprint"] == "".join(f"{x:012x}" for x in b)
        assert abs(r["near_edited"] - likeness(a, b)) < 1e-12 and abs(r["near_next"] - likeness(a, c)) < 1e-12
        w = [t.lower().split(), edited.lower().split()]
        true = likeness(*[{tuple(x[j:j + 5]) for j in range(max(1, len(x) - 4))} for x in w])
        errors.append(abs(true - r["near_edited"]))
    assert np.mean(errors) < 0.06


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = sketch.compare(docs).collect()
    assert len(got) == docs.count()
    assert all(0 <= r[c] <= 1 for r in got for c in ("near_edited", "near_next", "edited_within", "within_next"))
    assert {r["fingerprint"] for r in got if r["doc_id"] in (1, 2, 3)} == {""}
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (4, 5)}) == 1
    assert sketch.compare(empty_docs(spark)).count() == 0
    one = sketch.compare(docs.where("doc_id = 4").limit(1)).first()
    assert one["near_next"] == 1.0  # the only document follows itself


def test_sketches_merge(spark):
    texts = ["one two", "a b c d e", "", " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(30, 200)), "x"]
    rows = [(a, b) for a in texts for b in texts]
    frame = sketch.with_sketch(sketch.with_sketch(spark.createDataFrame(rows, "a string, b string"), "a", "sa"), "b", "sb")
    for r in frame.select("a", "b", sketch.merged(F.col("sa"), F.col("sb")).alias("m")).collect():
        every = sorted({g for t in (r["a"], r["b"]) for g in slow_grams(t)})
        assert r["m"] == ([g for g in every if g < sketch.LIMIT] or every[:1])
