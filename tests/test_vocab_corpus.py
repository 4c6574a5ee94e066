import hashlib

from pyspark.sql import functions as F

from textlab.config import VocabSettings
from textlab.operators import corpus, vocab
from textlab.operators.common import with_ordinal


def test_f1_vocab_ranking_and_ties(docs):
    d = docs([(0, "b a a"), (1, "c b")])
    v = {r["word"]: r["id"] for r in vocab.build_vocab(vocab.tokens(d)).collect()}
    assert v == {"[PAD]": 0, "[UNK]": 1, "b": 2, "a": 3, "c": 4}


def test_f1_cap_and_encoding(docs):
    d = docs([(0, "b a a"), (1, "c b"), (2, "")])
    s = VocabSettings(max_size=3, max_length=4)
    v = vocab.build_vocab(vocab.tokens(d), s)
    assert sorted(r["word"] for r in v.collect()) == ["[PAD]", "[UNK]", "b"]
    enc = {r["ord"]: (list(r["ids"]), r["n_tokens"]) for r in vocab.encode_ids(d, v, s).collect()}
    assert enc[1] == ([1, 2, 0, 0], 2)
    assert enc[2] == ([0, 0, 0, 0], 0)
    assert enc[0] == ([2, 1, 1, 0], 3)


def test_tokenizer_keeps_punctuation_and_strips_unicode_space(docs):
    d = docs([(0, "　Hello, world! "), (1, None)])
    toks = {r["ord"]: [] for r in d.collect()}
    for r in vocab.tokens(d).orderBy("ord", "pos").collect():
        toks[r["ord"]].append(r["token"])
    assert toks[0] == ["Hello", ",", "world", "!"]
    assert toks[1] == []


def test_decode_is_inverse(docs):
    d = docs([(0, "x y z x")])
    v = vocab.build_vocab(vocab.tokens(d))
    ids = vocab.token_ids(d, v).select("ord", "pos", "id")
    words = [r["word"] for r in vocab.id_to_word(v, ids).orderBy("pos").collect()]
    assert words == ["x", "y", "z", "x"]


def _py_fingerprint(texts, fanout):
    rows = [hashlib.md5(f"{i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()
            for i, t in enumerate(texts)]
    def fold(xs):
        return [hashlib.md5("".join(xs[b:b + fanout]).encode()).hexdigest()
                for b in range(0, len(xs), fanout)]
    return hashlib.md5("".join(fold(fold(rows))).encode()).hexdigest()


def test_fingerprint_matches_python_and_is_order_sensitive(docs):
    texts = [f"text {i}" for i in range(23)]
    d = docs(list(enumerate(texts)))
    got = corpus.fingerprint(d, fanout=5).first()
    assert got["fingerprint"] == _py_fingerprint(texts, 5)
    assert got["n_docs"] == 23
    swapped = texts[:]
    swapped[0], swapped[1] = swapped[1], swapped[0]
    assert corpus.fingerprint(docs(list(enumerate(swapped))), fanout=5).first()["fingerprint"] != got["fingerprint"]


def test_f11_no_newline_collision(docs):
    a = corpus.fingerprint(docs([(0, "a\nb")])).first()["fingerprint"]
    b = corpus.fingerprint(docs([(0, "a"), (1, "b")])).first()["fingerprint"]
    assert a != b


def test_distinct_texts_and_join_back(docs):
    d = docs([(0, "x"), (1, "y"), (2, "x")])
    u = corpus.distinct_texts(d)
    assert sorted((r["rep_ord"], r["n_copies"]) for r in u.collect()) == [(0, 2), (1, 1)]
    back = corpus.join_back(d, u.withColumn("n", F.col("n_copies")), ["n"])
    assert sorted((r["ord"], r["n"]) for r in back.collect()) == [(0, 2), (1, 1), (2, 2)]


def test_ordinal_is_dense_and_partition_independent(spark):
    df = spark.range(0, 1000, 7).withColumnRenamed("id", "k")
    for parts in (1, 3, 8):
        r = with_ordinal(df.repartition(parts), ["k"], num_partitions=parts)
        got = sorted((x["k"], x["rn"]) for x in r.collect())
        assert got == [(k, i + 1) for i, k in enumerate(range(0, 1000, 7))]


def test_strip_matches_python(docs):
    texts = ["  a b \t", "　x ", "\n\n", "y"]
    d = docs(list(enumerate(texts)))
    got = {r["ord"]: r["text"] for r in corpus.stripped(d).collect()}
    assert got == {i: t.strip() for i, t in enumerate(texts)}


def test_as_docs_dense_renumbers_gaps(spark):
    df = spark.createDataFrame([(50, "x"), (7, "y"), (1000, "z")], "doc_id bigint, body string")
    got = {r["doc_id"]: (r["ord"], r["text"]) for r in corpus.as_docs(df, "doc_id", "body", dense=True).collect()}
    assert got == {7: (0, "y"), 50: (1, "x"), 1000: (2, "z")}


def test_min_freq_and_specials(docs):
    d = docs([(0, "a a b [PAD]")])
    s = VocabSettings(min_freq=2)
    words = {r["word"]: r["id"] for r in vocab.build_vocab(vocab.tokens(d), s).collect()}
    assert words == {"[PAD]": 0, "[UNK]": 1, "a": 2}


def test_ranking_with_far_ords_and_a_small_cap(spark):
    from dataclasses import replace

    from textlab.config import DEFAULTS

    rows = [(0, "b a c"), (1, "a b d e"), (2, "f g a"), (3, "h i j k")]
    far = [((1 << 61) + i if i else -(1 << 61), t) for i, t in rows]
    for docs, cap in ((rows, 6), (far, 6), (rows, 100), (far, 100)):
        frame = spark.createDataFrame(docs, "ord bigint, text string")
        got = vocab.build_vocab(vocab.tokens(frame), replace(DEFAULTS.vocab, max_size=cap))
        words = [r["word"] for r in got.orderBy("id").collect()]
        assert words[2:] == "a b c d e f g h i j k".split()[:cap - 2]
