import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from helpers import empty_docs, odd_docs, rows_of

from textlab.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def both():
    own = bpe.Bpe(bpe.read_ranks(PATH), PATTERN)
    return own, tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_same_ids_as_tiktoken_on_documents(both):
    own, ref = both
    texts = [t for (t,) in rows_of("documents", "text")]
    assert [x.tolist() for x in own.encode(texts)] == [ref.encode_ordinary(t) for t in texts]


def test_same_ids_on_odd_white_space_and_marks(both):
    own, ref = both
    rng = random.Random(5)
    parts = ["a", "b", " ", "  ", "\n", "\t", "'s", "é", "1", "!", "\r\n", " ", "the", "'", " ", "%%%", "日", "\x1c"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(4000)]
    texts += ["ab" * 4000 + "!" * 999, " " * 700 + "x", "é" * 400, "日本語" * 300, "<|endoftext|> x"]
    found = own.encode(texts)
    for t, x in zip(texts, found, strict=True):
        assert x.tolist() == ref.encode_ordinary(t), repr(t)
        assert own.decode(x) == t.encode()


def test_words_kept_are_bounded(both, monkeypatch):
    own, ref = both
    monkeypatch.setattr(bpe, "PIECES", 10)
    for t in ("some words here", "and others there", "and some again"):
        assert own.encode([t] * 3)[2].tolist() == ref.encode_ordinary(t)


def test_round_trip_of_every_row(spark, both):
    docs = odd_docs(spark)
    out = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).collect()
    assert len(out) == docs.count()
    for r in out:
        ids = np.frombuffer(r["ids"], "<u4")
        assert ids.tolist() == both[1].encode_ordinary(r["text"] or "") and r["n_tokens"] == len(ids)
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    assert bpe.encode(empty_docs(spark), PATH, PATTERN).count() == 0
