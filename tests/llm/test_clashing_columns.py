"""Extra columns named like those that operators add or use inside: results are as without them."""

import corpus_pipeline
import pytest
from helpers import SMALL, odd_docs
from pyspark.sql import functions as F

from textlab.llm import bpe, langid, quality, queries, sharding, spans

EXTRA = ["component_id", "Lang_Pred", "score", "n_removed", "n_sentences", "shard", "slot", "n_tokens", "ids", "key",
         "__text", "__row", "__spans", "__score", "__null", "__letters", "__id"]


@pytest.fixture(scope="module")
def frames(spark):
    plain = odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars")
    return plain, plain.select("*", *[F.lit(f"own {c}").alias(c) for c in EXTRA])


def _rows(df, columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_operators(spark, frames):
    plain, more = frames
    net = langid.learn(plain)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 10)], "doc_id long, quality int")
    model = quality.learn(plain, labels)
    made = {
        "language": (lambda d: langid.predict(d, net), ["doc_id", "lang_pred", "score"]),
        "quality": (lambda d: quality.score(d, model), ["doc_id", "score"]),
        "sharding": (sharding.shard, ["doc_id", "size", "shard", "slot"]),
        "spans": (spans.dedup, ["doc_id", "text", "n_sentences", "n_removed"]),
        "bpe": (lambda d: bpe.encode(d, *queries.tokenizer()), ["doc_id", "ids", "n_tokens"]),
    }
    for name, (run, columns) in made.items():
        assert _rows(run(more), columns) == _rows(run(plain), columns), name


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:4])
def test_stages(spark, frames, tmp_path, name, stage):
    plain, more = frames
    spark.createDataFrame([(i, int(i != 9)) for i in range(1, 10)], "doc_id long, quality int") \
        .write.parquet(f"{tmp_path}/labels.parquet")
    got = stage(spark, more, str(tmp_path))
    assert got.columns == more.columns
    assert all(r[c] == f"own {c}" for r in got.collect() for c in EXTRA)
    assert _rows(got, plain.columns) == _rows(stage(spark, plain, str(tmp_path)), plain.columns)
