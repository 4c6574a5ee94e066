"""Reply store (commits, compaction, two writers) and the call budget of a whole stage."""

import time

import pytest

from textlab.operators import replies, tagging

COLUMNS = "prompt_key string, reply string, error string, run bigint"


def _state(spark, path):
    return sorted(tuple(r) for r in replies.best(replies.stored(spark, path)).collect())


def test_compaction_keeps_the_best_reply_of_each_prompt(spark, tmp_path):
    path = str(tmp_path / "store")
    add = lambda *rows: replies.append(spark.createDataFrame(list(rows), COLUMNS), path)
    assert replies.stored(spark, path).count() == 0 and replies.compact(spark, path) is None
    add(("a", "old", None, 1), ("b", None, "late", 1), ("c", None, "late", 1))
    assert replies.compact(spark, path) is None       # one commit has nothing to merge
    add(("a", "new", None, 2), ("b", "good", None, 2), ("c", None, "later", 2))
    add(("b", None, "odd", 3))
    want = [("a", "new", None, 2), ("b", "good", None, 3), ("c", None, "later", 2)]
    assert _state(spark, path) == want
    name = replies.compact(spark, path)
    assert _state(spark, path) == want and replies.stored(spark, path).count() == 3
    assert len(replies.commits(spark, path)) == 4     # the replaced ones stay for their readers
    add(("d", "one", None, 4))
    again = replies.compact(spark, path)
    assert _state(spark, path) == want + [("d", "one", None, 4)]
    assert set(replies.commits(spark, path)) > {name, again} and len(replies.commits(spark, path)) == 3


def test_the_number_of_files_follows_the_rows_not_the_runs(spark, tmp_path):
    path = str(tmp_path / "store")
    for run in range(6):
        replies.append(spark.createDataFrame([(f"{run}-{i}", "x", None, run) for i in range(10)], COLUMNS), path)
        name = replies.compact(spark, path, rows_per_file=25) or None
        assert len(replies.commits(spark, path)) <= 3
    files = list((tmp_path / "store" / f"commit={name}").glob("*.parquet"))
    assert replies.stored(spark, path).count() == 60 and len(files) <= 4   # three of rows, one of names


def test_writers_at_once_lose_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    add = lambda *rows: replies.append(spark.createDataFrame(list(rows), COLUMNS), path)
    add(("a", "1", None, 1))
    add(("b", "1", None, 1))
    real = replies.append

    def meanwhile(rows, where):       # a run and a second compaction end before the first compaction does
        monkeypatch.setattr(replies, "append", real)
        add(("c", "1", None, 2))
        replies.compact(spark, where)
        return real(rows, where)

    monkeypatch.setattr(replies, "append", meanwhile)
    replies.compact(spark, path)
    want = [("a", "1", None, 1), ("b", "1", None, 1), ("c", "1", None, 2)]
    assert _state(spark, path) == want
    for _ in range(3):
        replies.compact(spark, path)
        assert _state(spark, path) == want
    assert replies.stored(spark, path).count() == 3


def test_an_unfinished_commit_is_not_read(spark, tmp_path):
    path = str(tmp_path / "store")
    replies.append(spark.createDataFrame([("a", "x", None, 1)], COLUMNS), path)
    name = replies.append(spark.createDataFrame([("b", "half", None, 1)], COLUMNS), path)
    (tmp_path / "store" / f"commit={name}" / "_SUCCESS").unlink()
    assert [r[0] for r in _state(spark, path)] == ["a"]


def _calls(folder):
    return sorted(float(line) for f in folder.iterdir() for line in f.read_text().split())


@pytest.mark.parametrize("single", [False, True])
def test_tasks_together_stay_under_the_rate(spark, docs, tmp_path, single):
    folder = tmp_path / "calls"
    folder.mkdir()
    at = str(folder)

    def note(*args):
        import os
        with open(f"{at}/{os.getpid()}", "a") as f:
            f.write(f"{time.time()}\n")
        return "1: x"

    rate, width, n = 20.0, 3, 36
    texts = docs([(i, f"t{i}") for i in range(n)]).repartition(9)
    if single:
        out = tagging.label_each(texts, note, calls_per_s=rate, width=width)
    else:
        prompts = tagging.build_prompts(texts.selectExpr("ord", "text", "ord AS batch_id", "1 AS idx"))
        out = tagging.call_labeller(prompts, note, calls_per_s=rate, width=width)
    assert out.collect().__len__() == n
    calls = _calls(folder)
    assert len(calls) == n
    for i, t in enumerate(calls):
        for j in range(i + 1, n):     # a little slack for the clock between sleep and note
            assert j - i + 1 <= rate * (calls[j] - t + 0.05) + width


def test_a_budget_must_be_positive(spark, docs):
    with pytest.raises(ValueError):
        tagging.label_each(docs([(0, "a")]), calls_per_s=0)
