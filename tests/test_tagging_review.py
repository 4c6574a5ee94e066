from datetime import datetime

from textlab.operators import review, tagging

F4 = "<think>z: 1</think>1: a\n2: b:c \r\nnote\nx: y\n2: last\n３: w\n 4 : d"


def test_f4_reply_parse_and_quarantine(spark):
    replies = spark.createDataFrame([(0, F4, None)], "batch_id bigint, reply string, error string")
    labels, quarantine = tagging.parse_replies(replies)
    assert {r["idx"]: r["label"] for r in labels.collect()} == {1: "a", 2: "last", 4: "d"}
    assert sorted(r["line"] for r in quarantine.collect()) == ["x: y", "３: w"]


def test_f4_alignment_keeps_missing_as_null(spark, docs):
    d = docs([(i, f"t{i}") for i in range(4)])
    batched = tagging.assign_batches(d)
    replies = spark.createDataFrame([(0, F4, None)], "batch_id bigint, reply string, error string")
    labels, _ = tagging.parse_replies(replies)
    got = {r["ord"]: r["label"] for r in tagging.align(batched, labels, replies).collect()}
    assert got == {0: "a", 1: "last", 2: None, 3: "d"}


def test_f5_batches(docs):
    d = docs([(i, "t") for i in range(65)])
    b = tagging.assign_batches(d).groupBy("batch_id").agg({"idx": "min", "*": "count"}).collect()
    sizes = sorted((r["batch_id"], r["count(1)"], r["min(idx)"]) for r in b)
    assert sizes == [(0, 30, 1), (1, 30, 1), (2, 5, 1)]


def test_batches_with_gaps_use_dense_ordinal(docs):
    d = docs([(i * 10, "t") for i in range(35)])
    b = {r["ord"]: (r["batch_id"], r["idx"]) for r in tagging.assign_batches(d, dense=False).collect()}
    assert b[0] == (0, 1) and b[290] == (0, 30) and b[300] == (1, 1) and b[340] == (1, 5)


def test_f6_label_contract(spark):
    rows = [(0, "strong anger"), (1, "positive"), (2, ""), (3, "two\nlines"), (4, "a b c d e f")]
    df = spark.createDataFrame(rows, "ord bigint, label string")
    got = {r["ord"]: (r["valid"], r["reason"]) for r in tagging.validate(df).collect()}
    assert got[0] == (True, None)
    assert got[1] == (False, "generic")
    assert got[2] == (False, "empty")
    assert got[3] == (False, "multiline")
    assert got[4] == (False, "too_many_words")


def test_failed_call_goes_to_error_column(docs):
    def broken(batch_id, items, chat):
        raise RuntimeError("quota")
    d = docs([(i, "t") for i in range(3)])
    out = tagging.tag(d, broken)
    rows = out["aligned"].collect()
    assert all(r["label"] is None and "quota" in r["error"] for r in rows)


def test_rule_labeller_roundtrip(docs):
    d = docs([(i, "x" * i) for i in range(31)])
    out = tagging.tag(d)
    labels = {r["ord"]: r["label"] for r in out["aligned"].collect()}
    assert labels[0] == "label 0" and labels[4] == "label 4"     # idx 5: last line wins
    assert labels[10] is None and labels[12] is None             # idx 11 skipped, idx 13 'n/a'
    assert labels[30] == "label 0"                               # batch 1, odd: reasoning cut


def test_f10_review_overlay(spark):
    lab = spark.createDataFrame([(1, "a"), (2, "a")], "ord bigint, label string")
    rv = spark.createDataFrame([(1, "b", "correct", datetime(2024, 1, 1)),
                                (1, "c", "correct", datetime(2024, 1, 2))], review.REVIEW_SCHEMA)
    got = {r["ord"]: (r["label"], r["source"]) for r in review.overlay(lab, rv).collect()}
    assert got == {1: ("c", "human"), 2: ("a", "model")}


def test_reply_store_skips_done_batches(spark, docs):
    import tempfile

    def counting(batch_id, items, chat):
        return "\n".join(f"{i}: ok" for i, _ in items)

    path = tempfile.mkdtemp(prefix="textlab-test-") + "/replies"
    d = docs([(i, "t") for i in range(70)])
    prompts = tagging.build_prompts(tagging.assign_batches(d))
    run = lambda p: tagging.call_labeller(p, counting)
    first = tagging.store_replies(run, prompts, path)
    assert first.count() == 3
    again = tagging.store_replies(run, prompts, path)
    assert again.count() == 3   # nothing re-sent, nothing duplicated


def test_corpus_registry_is_write_once(spark, docs):
    import tempfile

    from textlab.operators import corpus
    path = tempfile.mkdtemp(prefix="textlab-test-") + "/registry"
    fp = corpus.fingerprint(docs([(0, "a"), (1, "b")]))
    assert corpus.register_corpus(None, fp, path) is True
    reg = spark.read.parquet(path)
    assert corpus.register_corpus(reg, fp, path) is False
    assert spark.read.parquet(path).count() == 1


def test_out_of_range_index_is_quarantined(spark, docs):
    d = docs([(i, "t") for i in range(3)])
    batched = tagging.assign_batches(d)
    replies = spark.createDataFrame([(0, "1: a\n7: ghost\n0: zero", None)], "batch_id bigint, reply string, error string")
    labels, _ = tagging.parse_replies(replies)
    bad = {r["idx"] for r in tagging.out_of_range(batched, labels).collect()}
    assert bad == {0, 7}
    got = {r["ord"]: r["label"] for r in tagging.align(batched, labels).collect()}
    assert got == {0: "a", 1: None, 2: None}


def test_single_text_labelling_strips_reasoning_and_records_errors(spark, docs):
    d = docs([(0, "ab"), (1, "abc")])
    got = {r["ord"]: r["label"] for r in tagging.label_each(d).collect()}
    assert got == {0: "tone 2", 1: "tone 3"}

    def broken(messages):
        raise TimeoutError("slow")
    rows = tagging.label_each(d, broken).collect()
    assert all(r["label"] is None and "slow" in r["error"] for r in rows)


def test_failed_calls_are_tried_again_and_replies_belong_to_their_text(spark, docs):
    import tempfile

    path = tempfile.mkdtemp(prefix="textlab-test-") + "/replies"
    prompts = tagging.build_prompts(tagging.assign_batches(docs([(i, f"t{i}") for i in range(70)])))

    def odd_fails(batch_id, items, chat):
        if batch_id % 2:
            raise TimeoutError("slow")
        return "\n".join(f"{i}: first" for i, _ in items)

    def works(batch_id, items, chat):
        assert chat[-1]["content"].startswith(tagging.ITEMS_HEADER)
        return "\n".join(f"{i}: second" for i, _ in items)

    def run(labeller, p=prompts):
        out = tagging.store_replies(lambda x: tagging.call_labeller(x, labeller, retries=0), p, path)
        return {r["batch_id"]: (r["reply"] or "")[:8] for r in out.collect()}

    assert run(odd_fails) == {0: "1: first", 1: "", 2: "1: first"}
    assert run(works) == {0: "1: first", 1: "1: secon", 2: "1: first"}
    other = tagging.build_prompts(tagging.assign_batches(docs([(i, f"u{i}") for i in range(30)])))
    assert run(works, other) == {0: "1: secon"}


def test_tag_job_keeps_every_text(spark, docs):
    from textlab.plans import pipeline

    job = pipeline.run_tag_job(docs([(i, "word " * (i % 9 + 1)) for i in range(130)]), algo="both")
    assert job.status == "clustered"
    rows = job.clusters.collect()
    assert len(rows) == 2 * 130 and {r["algo"] for r in rows} == {"kmeans", "hdbscan"}
    unlabelled = {r["ord"] for r in job.labels.collect() if r["label"] is None}
    assert {r["ord"] for r in rows if r["algo"] == "kmeans" and r["cluster"] is None} == unlabelled
    labelled = 130 - len(unlabelled)
    assert {r["n_samples"] for r in job.metrics.collect()} == {labelled}


def test_gate_skips_below_sixty_labels(spark):
    from textlab.plans import pipeline

    rows = lambda n: spark.createDataFrame([(i, f"l{i % 7}") for i in range(n)], "ord long, label string")
    assert pipeline.cluster_labels(rows(59), "kmeans")[0] == "skipped"
    assert pipeline.cluster_labels(rows(60), "kmeans")[0] == "clustered"


def test_a_registered_corpus_is_not_labelled_again(spark, docs, tmp_path):
    from textlab.plans import pipeline

    def broken(batch_id, items, chat):
        raise RuntimeError("not to be called")

    d, folder = docs([(i, f"text {i % 50}") for i in range(70)]), str(tmp_path)
    first = pipeline.run_tag_job(d, algo="kmeans", k=2, registry=folder)
    again = pipeline.run_tag_job(d, algo="kmeans", k=2, labeller=broken, registry=folder)
    assert sorted(map(str, first.labels.collect())) == sorted(map(str, again.labels.collect()))
    other = pipeline.run_tag_job(docs([(0, "new")]), algo="kmeans", labeller=broken, registry=folder)
    assert "not to be called" in other.labels.first()["error"]
