"""Stored level of the corpus digest: appends and edits hash their own groups alone."""

import pytest

from textlab.operators import corpus

FANOUT = 5


def _level(df):
    return {r["b"]: (r["d"], r["n"]) for r in df.collect()}


def _stored(spark, tmp_path, frame):
    corpus.group_digests(frame, FANOUT).write.parquet(str(tmp_path / "level"))
    return spark.read.parquet(str(tmp_path / "level"))


def _changes(old, new):
    return {r["b"]: (r["low"], r["high"], r["state"], r["n_old"], r["n_new"])
            for r in corpus.changed_groups(old, new, FANOUT).collect()}


def test_root_of_the_stored_level_is_the_fingerprint(spark, docs, tmp_path):
    d = docs([(i, f"t{i}") for i in range(137)])
    stored = _stored(spark, tmp_path, d)
    assert corpus.root(stored, FANOUT).first() == corpus.fingerprint(d, FANOUT).first()


@pytest.mark.parametrize("more", [0, 1, 2, 30])
def test_an_appended_corpus_reads_from_the_last_group_on(spark, docs, tmp_path, more):
    texts = [f"t{i}" for i in range(23 + more)]
    stored = _stored(spark, tmp_path, docs(list(enumerate(texts[:23]))))
    # rows before the last group (20 on) would give other digests if they were hashed again
    rows = [(i, t if i >= 20 else "not read") for i, t in enumerate(texts)]
    level = corpus.appended(stored, docs(rows), FANOUT)
    assert _level(level) == _level(corpus.group_digests(docs(list(enumerate(texts))), FANOUT))
    changed = _changes(stored, level)
    assert set(changed) == (set() if not more else set(range(4, (22 + more) // FANOUT + 1)))
    if more == 30:
        assert changed[4] == (20, 24, "changed", 3, 5) and changed[5] == (25, 29, "added", 0, 5)


def test_edited_removed_and_added_ids(spark, docs, tmp_path):
    texts = {i: f"t{i}" for i in range(40)}
    stored = _stored(spark, tmp_path, docs(list(texts.items())))
    after = dict(texts)
    after[7] = "other"
    for i in range(15, 20):
        del after[i]
    after[101] = "far"
    ids = spark.createDataFrame([(7,), *[(i,) for i in range(15, 20)], (101,), (33,)], "ord bigint")   # 33: same text
    unread = [(i, t if i // FANOUT in (1, 3, 6, 20) else "not read") for i, t in after.items()]
    level = corpus.edited(stored, docs(unread), ids, FANOUT)
    assert _level(level) == _level(corpus.group_digests(docs(list(after.items())), FANOUT))
    assert _changes(stored, level) == {1: (5, 9, "changed", 5, 5), 3: (15, 19, "removed", 5, 0),
                                       20: (100, 104, "added", 0, 1)}


def test_the_filter_of_an_append_reaches_the_scan(spark, docs, tmp_path):
    d = docs([(i, f"t{i}") for i in range(50)])
    d.write.parquet(str(tmp_path / "docs"))
    level = corpus.appended(_stored(spark, tmp_path, d), spark.read.parquet(str(tmp_path / "docs")), FANOUT)
    assert "GreaterThanOrEqual(ord,45)" in level._jdf.queryExecution().toString().replace(" ", "")


def test_empty_corpora(spark, docs, tmp_path):
    stored = _stored(spark, tmp_path, docs([]))
    d = docs([(0, None), (1, "")])
    assert _level(corpus.appended(stored, d, FANOUT)) == _level(corpus.group_digests(d, FANOUT))
    assert corpus.changed_groups(stored, stored, FANOUT).count() == 0
    assert corpus.root(stored, FANOUT).first()["n_docs"] is None
