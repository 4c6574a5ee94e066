import hashlib
import random
import re

import duckdb
import pytest
from helpers import SMALL, empty_docs, odd_docs, rows_of

from textlab.llm import decontaminate, queries
from textlab.llm.oracles import ORACLES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def normal(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute(text, items, window=10):
    """(words, offsets of hit words, ids of items found) by comparing every stretch of words."""
    found = [(m.group(), m.start(), m.end()) for m in WORD.finditer(normal(text))]
    words = [f[0] for f in found]
    hit, names = set(), set()
    for item, body in items:
        w = WORD.findall(normal(body))
        for j in range(max(1, len(w) - window + 1)) if w else ():
            part = w[j:j + window]
            for i in range(len(words) - len(part) + 1):
                if words[i:i + len(part)] == part:
                    hit |= set(range(i, i + len(part)))
                    names |= {item} - {None}
    return words, sorted(hit), names, found


def spans_of(hit, found):
    out = []
    for i in hit:
        if out and out[-1][1] == i:
            out[-1][1] = i + 1
        else:
            out.append([i, i + 1])
    return [(found[a][1], found[b - 1][2]) for a, b in out]


def random_case(rng):
    word = lambda: "".join(rng.choice("abAB1é") for _ in range(rng.randrange(1, 3)))
    gap = lambda: rng.choice([" ", ", ", "\n", "--", "\u0000 "])
    text = lambda n: "".join(word() + gap() for _ in range(n))
    items = [(i % 9, text(rng.randrange(0, 18))) for i in range(12)] + [(None, text(6)), (50, None), (51, "日本語 é")]
    docs = []
    for i in range(40):
        body = text(rng.randrange(0, 40))
        if i % 3 == 0:
            body += (rng.choice(items)[1] or "").upper().replace(" ", " ;; ")
        docs.append((i, body))
    return docs + [(None, None), (3, "日本語 É 日本語 é é"), (3, "日本語 É 日本語 é é")], items


@pytest.mark.parametrize("patterns", [decontaminate.PATTERNS, 7])
def test_same_as_brute_force(spark, patterns):
    docs, items = random_case(random.Random(5))
    got = decontaminate.scan(spark.createDataFrame(docs, "doc_id long, text string"),
                             spark.createDataFrame(items, "item_id long, text string"), window=4, patterns=patterns)
    rows = sorted(got.collect(), key=lambda r: (str(r["doc_id"]), str(r["text"])))
    assert len(rows) == len(docs)
    caught = 0
    for r in rows:
        words, hit, names, found = brute(r["text"], items, 4)
        assert (r["n_words"], r["n_hit"], set(r["items"])) == (len(words), len(hit), names)
        assert len(r["items"]) == len(names)
        assert [(s["begin"], s["end"]) for s in r["spans"]] == spans_of(hit, found)
        caught += bool(hit)
    assert 10 < caught < len(docs)


def test_query_same_as_sql_and_brute_force(spark):
    got = {r["doc_id"]: r for r in queries.op12_decontaminate(spark, SMALL).collect()}
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = con.sql(ORACLES["op12_decontaminate"]).fetchall()
    assert {tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
            for r in got.values()} == set(want)
    assert any(r["contaminated"] for r in got.values())
    items = rows_of("benchmark", "item_id, text")
    for doc, text in rows_of("documents", "doc_id, text")[:25]:
        words, hit, names, _ = brute(text, items)
        digest = hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest()
        r = got[doc]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (len(words), len(hit), len(names), digest)


def test_odd_rows(spark):
    docs = odd_docs(spark).selectExpr("*", "1 as n_hit", "'x' as ITEMS", "2 as spans", "3 as __runs")
    items = spark.createDataFrame([(1, "One, TWO!", "x"), (1, "none; NONE", "y"), (None, "日本語", "z"), (2, "", "x"), (3, None, "x")],
                                  "item_id long, text string, n_words string")
    rows = decontaminate.scan(docs, items).collect()
    assert len(rows) == docs.count() and not {"ITEMS", "__runs"} & set(rows[0].asDict())
    assert {r["text"] for r in rows if r["n_hit"]} == {"one two", "no id here at all, none. None!", "日本語 é ñ ß — 12 % $$"}
    assert all(r["items"] == ([] if "日" in r["text"] else [1]) for r in rows if r["n_hit"])
    assert decontaminate.clean(odd_docs(spark), items).columns == odd_docs(spark).columns
    assert decontaminate.clean(odd_docs(spark), items).count() == sum(not r["n_hit"] for r in rows)
    assert decontaminate.scan(empty_docs(spark), items).count() == 0
    assert all(r["n_hit"] == 0 for r in decontaminate.scan(docs, items.limit(0)).collect())
