import random

from helpers import empty_docs, odd_docs, rows_of

from textlab.llm import spans


def brute(rows):
    """What is left of each text, by comparing spans as texts."""
    def spans_of(text):
        s = spans.sentences(text)
        words = [x.lower().split() for x in s]
        out = []
        for i in range(len(s)):
            j, n = i, 0
            while j < len(s) and (n < spans.WORDS or j - i < spans.SENTENCES):
                n += max(1, len(words[j]))
                j += 1
            if n >= spans.WORDS and j - i >= spans.SENTENCES:
                out.append((tuple(" ".join(w) for w in words[i:j]), i, j))
        return s, out

    first, left = {}, {}
    for doc, text in sorted(rows):
        s, found = spans_of(text)
        gone = set()
        for key, i, j in found:
            if key in first:
                gone |= set(range(i, j))
            first.setdefault(key, doc)
        left[doc] = "".join(x for k, x in enumerate(s) if k not in gone)
    return left


def test_sentences_are_the_text():
    for (t,) in rows_of("documents", "text"):
        assert "".join(spans.sentences(t)) == t


def test_same_as_brute_force_on_documents(spark):
    rows = rows_of("documents", "doc_id, text")
    got = {r["doc_id"]: r for r in spans.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert {k: r["text"] for k, r in got.items()} == want
    assert {k for k, r in got.items() if r["n_removed"]} == {k for k, t in rows if want[k] != t}


def test_passages_are_caught_and_clean_texts_left_alone(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(4, 18))) + ". "
    passage = " ".join(word() for _ in range(20)) + ". " + " ".join(word() for _ in range(36)) + "."
    unbroken = " ".join(word() for _ in range(80))
    rows = []
    for i in range(40):
        before, after = "".join(sentence() for _ in range(5)), "".join(sentence() for _ in range(5))
        middle = {0: passage + " ", 1: unbroken + " "}.get(i % 4, "")
        rows.append((i, before + middle + after))
    got = {r["doc_id"]: r for r in spans.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        if i % 4 > 1 or i < 2:
            assert got[i]["text"] == t and got[i]["n_removed"] == 0
        elif i % 4 == 0:
            assert passage not in got[i]["text"] and got[i]["n_removed"]
        else:
            left = sum(w in got[i]["text"].split() for w in unbroken.split())
            assert left < 40


def test_odd_rows(spark):
    docs = odd_docs(spark)
    out = spans.dedup(docs)
    assert [c for c in out.columns if c in docs.columns] == docs.columns
    got = out.collect()
    assert len(got) == docs.count()
    assert all((r["text"] is None) == (r["doc_id"] == 1 or (r["doc_id"] is None and r["lang"] is None)) for r in got)
    assert {len(r["text"]) for r in got if r["doc_id"] == 7} == {0, 25}  # a copy of document 6 goes whole
    assert spans.dedup(empty_docs(spark)).count() == 0


def random_text(rng, alphabet, length, ends, space):
    p = rng.choice([0, 0, 0.02, 0.06, 0.1, 0.3])
    return space.join("".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 9) if space else 1))
                      + (rng.choice(ends) if rng.random() < p else "") for _ in range(length))


def test_every_passage_of_over_50_words_holds_a_span():
    rng = random.Random(7)
    for alphabet, length, ends, space in (("abcdefghij", 51, ".!\n", " "),
                                          ([chr(0x4E00 + i) for i in range(400)], 102, "。！", ""),
                                          ([chr(0xE01 + i) for i in range(40)], 306, "\n", "")):
        for _ in range(300):
            passage = random_text(rng, alphabet, length, ends, space)
            a, b = (space.join([random_text(rng, alphabet, rng.randrange(length), ends, space), passage,
                                random_text(rng, alphabet, rng.randrange(length), ends, space)]) for _ in range(2))
            assert "".join(spans.sentences(a)) == a
            assert set(spans.spans(a)[0].tolist()) & set(spans.spans(b)[0].tolist())


def test_passage_of_ten_chinese_sentences(spark):
    rng = random.Random(4)
    sentence = lambda: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(rng.randrange(10, 20))) + "。"
    passage = "".join(sentence() for _ in range(10))
    rows = [(i, "".join(sentence() for _ in range(4)) + passage + "".join(sentence() for _ in range(4))) for i in range(3)]
    got = {r["doc_id"]: r for r in spans.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["text"] == rows[0][1]
    assert all(got[i]["text"] == rows[i][1].replace(passage, "") for i in (1, 2))


def test_rows_that_share_an_id_or_have_none(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    sentence = lambda: " ".join(word() for _ in range(rng.randrange(4, 12))) + ". "
    passage, other = "".join(sentence() for _ in range(12)), "".join(sentence() for _ in range(12))
    own = lambda: "".join(sentence() for _ in range(4))
    copy = own() + other
    rows = [(None, own() + passage + own()) for _ in range(3)] + [(1, own() + passage), (1, passage + own())]
    rows += [(None, copy)] * 40 + [(2, other)] * 3 + [(3, own()), (4, None), (None, None), (None, None), (5, ""), (5, "")]
    rng.shuffle(rows)
    got = spans.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert len(got) == len(rows)
    left = lambda s: sum(s in (r["text"] or "") for r in got)
    assert left(passage) == 1 and left(other) == 1
    assert [r["doc_id"] for r in got if r["text"] and passage in r["text"]] == [1]
    assert [r["doc_id"] for r in got if r["text"] and other in r["text"]] == [2]
    assert sum(r["n_removed"] > 0 for r in got) == 3 + 1 + 40 + 2
    assert sum(r["text"] is None for r in got) == 3
