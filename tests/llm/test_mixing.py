import duckdb
from helpers import SMALL, empty_docs, odd_docs

from textlab.llm import mixing, queries
from textlab.llm.oracles import ORACLES


def test_same_as_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    cur = con.execute(ORACLES["op2_mixing"])
    names = [c[0] for c in cur.description]
    want = sorted(map(str, ([dict(zip(names, r, strict=True))[c] for c in sorted(names)] for r in cur.fetchall())))
    got = queries.op2_mixing(spark, SMALL)
    assert sorted(str([r[c] for c in sorted(names)]) for r in got.collect()) == want


def test_targets_and_caps(spark):
    rows = [(i, "w " * n, s) for i, (n, s) in enumerate([(10, "a")] * 40 + [(5, "b")] * 40 + [(30, "c")] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.copies(docs).collect()
    size, target = ({r["source"]: r[c] for r in got} for c in ("source_size", "target"))
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    assert target["a"] == 2 * size["a"] and target["b"] == 2 * size["b"]
    for s in size:
        taken = sum(r["copies"] * r["size"] for r in got if r["source"] == s)
        assert abs(taken - target[s]) <= max(r["size"] for r in got if r["source"] == s)
    assert all(r["copies"] <= 2 for r in got)
    emitted = mixing.emit(docs).collect()
    assert sorted(r["doc_id"] for r in emitted) == sorted(r["doc_id"] for r in got for _ in range(r["copies"]))


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = mixing.copies(docs).collect()
    assert len(got) == docs.count()
    assert all(r["copies"] * r["size"] <= 2 * r["size"] for r in got)
    assert {r["size"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}
    emitted = mixing.emit(docs)
    assert emitted.columns == docs.columns and emitted.count() == sum(r["copies"] for r in got)
    assert mixing.copies(empty_docs(spark)).count() == 0 and mixing.emit(empty_docs(spark)).count() == 0


def test_many_sources_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_BYTES", 10)
    docs = spark.createDataFrame([(i, "w " * (i % 5 + 1), f"s{i % 30}") for i in range(300)],
                                 "doc_id long, text string, source string")
    got = mixing.copies(docs)
    monkeypatch.undo()
    assert sorted(map(str, got.collect())) == sorted(map(str, mixing.copies(docs).collect()))
