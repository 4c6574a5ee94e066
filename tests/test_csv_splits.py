"""CSV files with quoted newlines, read by many tasks: against Spark's reader of whole files."""

import random

import pytest

from textlab.sources import files

PIECES = ["a", "b c", ",", "\n", "\n\n", '"', '""', "\r\n", "é", "好", " x ", "long " * 30, "\\", "'"]


@pytest.fixture
def small_splits(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "400")
    yield
    spark.conf.set(name, before)


def _field(text):
    return '"' + text.replace('"', '""') + '"'


def _rows(df):
    return sorted((r["id"], r["text"]) for r in df.collect())


@pytest.mark.parametrize("seed,end", [(1, "\n"), (2, "\n"), (3, "\r\n"), (4, "\n")])
def test_records_across_splits_equal_the_whole_file_reader(spark, tmp_path, small_splits, seed, end):
    rnd = random.Random(seed)
    folder = tmp_path / "in.csv"
    folder.mkdir()
    want = []
    for part in range(3):
        lines = ["id,text,ord"]
        for i in range(rnd.choice([0, 1, 60])):
            text = "".join(rnd.choice(PIECES) for _ in range(rnd.randrange(1, 9)))
            if i == 7:
                text = "line, \"quoted\"\n" * 200        # over many splits
            want.append((f"{part}-{i}", text))
            lines.append(f"{part}-{i},{_field(text)},own")
            if rnd.random() < 0.1:
                lines.append("")
        (folder / f"part-{part}.csv").write_bytes((end.join(lines) + end * rnd.choice([0, 1])).encode())
    got = files.read_texts(spark, str(folder), keep_all=True)
    rows = got.orderBy("ord").collect()
    assert [r["ord"] for r in rows] == list(range(len(want)))
    assert [(r["id"], r["text"]) for r in rows] == want
    if end == "\n":     # where records end with \r\n, Spark's reader also shortens it inside quotes
        assert _rows(got) == _rows(files.read_table(spark, str(folder), whole_files=True))
    assert [(r["ord"], r["text"]) for r in files.read_texts(spark, str(folder)).orderBy("ord").collect()] \
        == [(i, t) for i, (_, t) in enumerate(want)]


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_splits):
    path = tmp_path / "one.csv"
    path.write_text("id,text\n" + "".join(f"{i},{_field(f'first {i}' + chr(10) + 'second')}\n" for i in range(400)))
    df = files.read_texts(spark, str(path))
    assert df.rdd.getNumPartitions() > 10
    got = {r["ord"]: r["text"] for r in df.collect()}
    assert got == {i: f"first {i}\nsecond" for i in range(400)}
    assert files.read_table(spark, str(path), whole_files=True).rdd.getNumPartitions() == 1


def test_without_a_broadcast_the_lines_are_put_in_order_again(spark, tmp_path, small_splits, monkeypatch):
    path = tmp_path / "one.csv"
    want = [f"x{i}\n" * (i % 40 + 1) for i in range(60)]
    path.write_text("text\n" + "".join(_field(t) + "\n" for t in want))
    monkeypatch.setattr(files, "broadcast_measured", lambda df: df)
    rows = files.read_texts(spark, str(path)).orderBy("ord").collect()
    assert [r["text"] for r in rows] == want


@pytest.mark.parametrize("body", ['5" disk\n6" disk\n', '"a" b\n', 'a "b" c\n', '"open\n'])
def test_stray_quotes_are_an_error_not_a_wrong_row(spark, tmp_path, body):
    path = tmp_path / "odd.csv"
    path.write_text("text\nfine\n" + body)
    with pytest.raises(Exception, match="whole_files"):
        files.read_texts(spark, str(path)).collect()


@pytest.mark.parametrize("body", ["text\n", "text", "text\n\n\n"])
def test_a_header_alone_is_an_empty_table(spark, tmp_path, body):
    path = tmp_path / "none.csv"
    path.write_text(body)
    assert files.read_texts(spark, str(path)).collect() == []
