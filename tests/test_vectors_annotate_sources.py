import json
import os
import tempfile

import pytest

from textlab.operators import annotate, vectors, vocab
from textlab.sources import files


def _vocab(spark, words):
    rows = [("[PAD]", 0, None), ("[UNK]", 1, None)] + [(w, i + 2, 1) for i, w in enumerate(words)]
    return spark.createDataFrame(rows, "word string, id bigint, cnt bigint")


def test_f2_word_vector_file(spark):
    d = tempfile.mkdtemp(prefix="textlab-test-")
    path = os.path.join(d, "vec.txt")
    with open(path, "w") as f:
        f.write("3 2\na 1 0\nb 1 2 3\n\na 0 1\nzz 5 5\n")
    v = _vocab(spark, ["a", "b"])
    wv = files.read_word_vectors(spark, path, v, dim=2)
    got = {r["word"]: list(r["vec"]) for r in wv.collect()}
    assert got == {"a": [0.0, 1.0]}
    table = {r["id"]: list(r["vec"]) for r in vectors.vector_table(v, wv, 2).collect()}
    assert table[1] == [0.0, 1.0] and table[0] == [0.0, 0.0] and table[3] == [0.0, 0.0]
    docs = spark.createDataFrame([(0, "a a"), (1, "")], "ord bigint, text string")
    pooled = {r["ord"]: list(r["vec"]) for r in vectors.sentence_vectors(docs, v, wv, 2, normalize=False).collect()}
    assert pooled == {0: [0.0, 1.0], 1: [0.0, 0.0]}


def test_zero_vector_stays_zero_and_edge_pad(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [3.0, 4.0])], "ord bigint, vec array<double>")
    got = {r["ord"]: list(r["vec"]) for r in vectors.normalized(df).collect()}
    assert got == {0: [0.0, 0.0], 1: [0.6, 0.8]}
    padded = vectors.at_edge(df).first()["vec"]
    assert len(padded) == 768 and padded[2:] == [0.0] * 766


def test_hashing_encoder_dedups_and_is_unit_norm(spark):
    docs = spark.createDataFrame([(0, "same text"), (1, "same text"), (2, "other")], "ord bigint, text string")
    enc = {r["ord"]: r["vec"] for r in vectors.encode_with(docs).collect()}
    assert enc[0] == enc[1]
    assert sum(x * x for x in enc[2]) == pytest.approx(1.0, rel=1e-5)


F3 = [(1, 1, 1, "x", "NOUN", 2, "nsubj"), (1, 1, 2, "go", "NOUN", 0, "root"),
      (1, 1, 3, "run", "VERB", 0, "root"), (1, 2, 1, "eat", "VERB", 0, "root"),
      (2, 1, 1, "a", "DET", 2, "det"), (2, 2, 1, "ok", "ADJ", 0, "root"),
      (3, 1, 1, "red", "ADJ", 2, "amod"), (3, 1, 2, "car", "NOUN", 0, "root"),
      (3, 1, 3, "big", "ADJ", 2, "amod")]


def test_f3_analysis(spark):
    toks = spark.createDataFrame(F3, annotate.PARSE_SCHEMA)
    docs = spark.createDataFrame([(i, "") for i in (1, 2, 3, 4)], "ord bigint, text string")
    got = {r["ord"]: r for r in annotate.analyze(docs, toks).collect()}
    assert got[1]["subjects"] == ["x"] and got[1]["main_event"] == "run"
    assert got[1]["keywords"] == ["eat", "go", "run"]
    assert got[2]["main_event"] == "ok" and got[2]["adj_pairs"] == []
    assert [(p["adjective"], p["subject"]) for p in got[3]["adj_pairs"]] == [("red", "car"), ("big", "car")]
    assert got[4]["subjects"] == [] and got[4]["main_event"] is None and got[4]["entities"] == []


def test_entities_in_text_order(spark):
    docs = spark.createDataFrame([(0, "mail a.b@x.org on 2024-01-02 pay 12,5 now")], "ord bigint, text string")
    got = [(r["text"], r["type"]) for r in annotate.entities(docs).orderBy("ent_ord").collect()]
    assert got == [("a.b@x.org", "EMAIL"), ("2024-01-02", "DATE"), ("12,5", "NUMBER")]


def test_csv_reader_quoted_newlines_and_missing_column(spark):
    d = tempfile.mkdtemp(prefix="textlab-test-")
    path = os.path.join(d, "in.csv")
    with open(path, "w") as f:
        f.write('id,text\n1,"line one\nline two"\n2,"say ""hi"""\n3,\n')
    got = {r["ord"]: r["text"] for r in files.read_texts(spark, path).collect()}
    assert got == {0: "line one\nline two", 1: 'say "hi"', 2: None}
    with pytest.raises(ValueError, match="content"):
        files.read_texts(spark, path, column="content")
    with pytest.raises(ValueError):
        files.read_table(spark, os.path.join(d, "in.xlsx"))


def test_label_json_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="textlab-test-")
    path = os.path.join(d, "tags.json")
    with open(path, "w") as f:
        json.dump(["喜悦", "mild relief", "anger"], f, ensure_ascii=False)
    got = [r["label"] for r in files.read_label_array(spark, path).orderBy("ord").collect()]
    assert got == ["喜悦", "mild relief", "anger"]


def test_cjk_tokenizer_splits_han(spark):
    docs = spark.createDataFrame([(0, "今天天气真好，we go")], "ord bigint, text string")
    toks = [r["token"] for r in vocab.tokens(docs, cjk=True).orderBy("pos").collect()]
    assert toks == ["今", "天", "天", "气", "真", "好", "，", "we", "go"]


def test_word_vector_file_edge_cases(spark):
    d = tempfile.mkdtemp(prefix="textlab-test-")
    path = os.path.join(d, "vec.txt")
    with open(path, "w") as f:
        f.write("  \n2 3\nb 1 x\nb 1 2\nc 1 2 3\n  c 4 5  \n")
    v = _vocab(spark, ["b", "c"])
    got = {r["word"]: list(r["vec"]) for r in files.read_word_vectors(spark, path, v, dim=2).collect()}
    # "b 1 x" is not a number row and is dropped; "2 3" is a header; width 3 dropped
    assert got == {"b": [1.0, 2.0], "c": [4.0, 5.0]}
    cov = vocab.coverage(v, files.read_word_vectors(spark, path, v, dim=2)).first()
    assert (cov["found"], cov["needed"]) == (2, 4)


def test_null_text_option(spark):
    d = tempfile.mkdtemp(prefix="textlab-test-")
    path = os.path.join(d, "in.csv")
    with open(path, "w") as f:
        f.write("id,text\n1,hello\n2,\n")
    got = [r["text"] for r in files.read_texts(spark, path, null_text="nan").orderBy("ord").collect()]
    assert got == ["hello", "nan"]
    kept = [r["text"] for r in files.read_texts(spark, path).orderBy("ord").collect()]
    assert kept == ["hello", None]


def test_injected_segmenter_and_single_encoding(spark):
    docs = spark.createDataFrame([(0, " ab cd "), (1, "")], "ord bigint, text string")
    toks = vocab.tokens_with(docs, lambda: (lambda t: [t[i:i + 2] for i in range(0, len(t), 3)]))
    got = [(r["ord"], r["pos"], r["token"]) for r in toks.orderBy("ord", "pos").collect()]
    assert got == [(0, 0, "ab"), (0, 1, "cd")]
    one = vectors.encode_one(spark, "hello world").collect()
    assert len(one) == 1 and len(one[0]["vec"]) == 64


def test_gazetteer_entities(spark):
    toks = spark.createDataFrame(F3, annotate.PARSE_SCHEMA)
    gaz = spark.createDataFrame([("car", "VEHICLE"), ("run", "ACTION")], "phrase string, type string")
    got = sorted((r["ord"], r["text"], r["type"]) for r in annotate.gazetteer_entities(toks, gaz).collect())
    assert got == [(1, "run", "ACTION"), (3, "car", "VEHICLE")]


def test_gazetteer_phrases_of_any_length(spark):
    words = "the old red car of the old man in the small town by the old red sea wall".split()
    toks = spark.createDataFrame([(1, s, i + 1, w, "X", 0, "x") for s in (0, 1) for i, w in enumerate(words)],
                                 annotate.PARSE_SCHEMA)
    phrases = [" ".join(words[a:b]) for a, b in ((0, 1), (0, 3), (1, 3), (4, 11), (0, 17), (2, 14))] + ["the old blue", "", "sea  wall"]
    gaz = spark.createDataFrame([(p, "P") for p in phrases] + [("car", "A"), ("car", "B")], "phrase string, type string")
    got = sorted((r["sent_id"], r["word_id"], r["text"], r["type"]) for r in annotate.gazetteer_entities(toks, gaz).collect())
    want = [(s, i + 1, p, "P") for s in (0, 1) for p in phrases for i in range(len(words))
            if p and words[i:i + len(p.split(" "))] == p.split(" ")]
    assert got == sorted(want + [(s, 4, "car", t) for s in (0, 1) for t in "AB"])
    assert annotate.gazetteer_entities(toks, gaz.limit(0)).count() == 0
