"""Label assignment by batch prompting and strict reply parsing.

Texts are cut into consecutive batches of ``batch_size`` (global ordinal, no
single-partition window), each batch becomes one prompt, an injected labeller
answers ``"i: label"`` lines, and replies are parsed relationally and joined
back to texts by ``(batch_id, idx)`` - a missing index never shifts labels.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.config import DEFAULTS, TagSettings
from textlab.functions.text import strip_keep_null, strip_reasoning
from textlab.operators import replies as reply_store
from textlab.operators.common import broadcast_measured, cut_lineage, with_ordinal

# The label contract's generic polarity words (rejected labels).
GENERIC_LABELS = ("positive", "negative", "neutral", "good review", "bad review")

# The label contract in our words, from the values that ``validate`` checks.
SYSTEM_PROMPT = (
    f"Name the feeling in each text with a label of at most {DEFAULTS.tags.max_label_words} words that says "
    "which emotion it is and how strong. Write the label in the text's own language and nothing else. "
    f"These say too little: {', '.join(GENERIC_LABELS)}."
)
FORMAT_PROMPT = "Answer with one line per text, exactly in the form\n<number>: <label>"
ITEMS_HEADER = "Texts to label:\n"

# (batch id, [(index, text)], chat messages) -> reply
Labeller = Callable[[int, list[tuple[int, str]], list[dict]], str]


# ---------------------------------------------------------------- L1
def assign_batches(docs: DataFrame, settings: TagSettings = DEFAULTS.tags,
                   dense: bool = True) -> DataFrame:
    """L1: ``(ord, text, batch_id BIGINT, idx INT)``; idx is 1-based inside a batch.

    ``dense=True`` means ``ord`` is already a gap-free 0-based ordinal. Else a
    distributed ordinal over ``ord`` is computed first.
    """
    if dense:
        rn0 = F.col("ord")
        keyed = docs
    else:
        ranks = with_ordinal(docs.select("ord"), ["ord"], name="_rn")
        keyed = docs.join(ranks, "ord")
        rn0 = F.col("_rn") - 1
    size = settings.batch_size
    out = keyed.withColumn("batch_id", F.floor(rn0 / F.lit(size)).cast("bigint")) \
               .withColumn("idx", (F.pmod(rn0, F.lit(size)) + 1).cast("int"))
    return out.drop("_rn") if not dense else out


# ---------------------------------------------------------------- L2
def build_prompts(batched: DataFrame) -> DataFrame:
    """L2: one row per batch: ``batch_id, n_texts, items, prompt``.

    ``items`` is the ordered ``array<struct<idx,text>>`` (<= batch_size rows,
    a bounded group); ``prompt`` is the user message with ``"i. text"`` lines.
    """
    per = batched.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("items"))
    lines = F.transform("items", lambda x: F.concat(x["idx"].cast("string"), F.lit(". "),
                                                    F.coalesce(x["text"], F.lit(""))))
    return per.select(
        "batch_id",
        F.size("items").alias("n_texts"),
        "items",
        F.concat(F.lit(ITEMS_HEADER), F.array_join(lines, "\n")).alias("prompt"),
    )


def messages(prompt: str) -> list[dict]:
    """Chat messages for one batch prompt (system, format, user)."""
    return [{"role": "system", "content": SYSTEM_PROMPT},
            {"role": "system", "content": FORMAT_PROMPT},
            {"role": "user", "content": prompt}]


def single_prompt(text: str) -> list[dict]:
    """Single-text form of the prompt."""
    return [{"role": "system", "content": SYSTEM_PROMPT},
            {"role": "user", "content": f"Text: {text}"}]


# ---------------------------------------------------------------- L3
def rule_labeller(batch_id: int, items: list[tuple[int, str]], chat: list[dict]) -> str:
    """Deterministic stand-in labeller (not a sentiment model).

    Answers in the reply format with a few realistic defects: an index it
    skips (multiples of 11), a non-numeric index (multiples of 13), a repeated
    index (5, first answer superseded) and a reasoning block on odd batches.
    """
    lines = []
    for idx, text in sorted(items):
        n = len(text or "")
        if idx % 11 == 0:
            continue
        if idx % 13 == 0:
            lines.append(f"n/a: {n}")
            continue
        if idx == 5:
            lines.append("5: first")
        lines.append(f"{idx}: label {n % 10}")
    reply = "\n".join(lines)
    return ("<think>1: x</think>" + reply) if batch_id % 2 == 1 else reply


class Pace:
    """Least time between two calls of a task; also before its first one, so that tasks which follow
    one another on a core keep the pace together."""

    def __init__(self, seconds: float):
        self.seconds, self.last = seconds, time.monotonic()

    def wait(self) -> None:
        if self.seconds:
            time.sleep(max(0.0, self.last + self.seconds - time.monotonic()))
            self.last = time.monotonic()


def _ask(call: Callable[[], str], pace: Pace, retries: int, backoff_s: float = 0.0) -> tuple[str | None, str | None]:
    """``(reply, error)`` of a call, tried again up to ``retries`` times; each try waits for its turn."""
    err = None
    for attempt in range(retries + 1):
        pace.wait()
        try:
            return call(), None
        except Exception as e:  # noqa: BLE001 - recorded, not raised
            err = f"{type(e).__name__}: {e}"
            if backoff_s and attempt < retries:
                time.sleep(backoff_s * (2 ** attempt))
    return None, err


def _budgeted(rows: DataFrame, pause_s: float, calls_per_s: float | None, width: int) -> tuple[DataFrame, float]:
    """Rows for the call stage, and the pause of each of its tasks.

    A budget for the whole job needs a number of tasks at once that does not depend on the cluster: the rows
    are dealt to ``width`` partitions, which share the budget evenly.
    """
    if calls_per_s is None:
        return rows, pause_s
    if calls_per_s <= 0 or width < 1:
        raise ValueError(f"calls_per_s and width must be positive, not {calls_per_s} and {width}")
    return rows.repartition(width), max(pause_s, width / calls_per_s)


def call_labeller(prompts: DataFrame, labeller: Labeller = rule_labeller,
                  retries: int = 2, backoff_s: float = 0.0, pause_s: float = 0.0,
                  calls_per_s: float | None = None, width: int = 8) -> DataFrame:
    """L3 + L7: ``(batch_id, reply, error)`` - one labeller call per batch row.

    The labeller gets the batch's texts and the chat messages made of its
    prompt. Runs as ``mapInPandas`` over Arrow batches of prompt rows; a failing call is
    retried, then recorded in ``error`` with a NULL reply (never as a label).
    ``pause_s`` is the least time between two calls of a task. ``calls_per_s`` bounds the calls of the whole
    stage, retries included, on any number of cores: at most ``width`` calls run at once, and any t
    seconds see at most ``calls_per_s * t + width`` of them. A task that Spark runs twice at once (speculation) counts twice.
    """
    todo, pause = _budgeted(prompts.select("batch_id", "items", "prompt"), pause_s, calls_per_s, width)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(pause)
        for pdf in it:
            asked = []
            for bid, items, prompt in zip(pdf["batch_id"].values, pdf["items"].values, pdf["prompt"].values):
                pairs = [(int(x["idx"]), x["text"]) for x in items]
                asked.append(_ask(lambda: labeller(int(bid), pairs, messages(prompt)), pace, retries, backoff_s))
            yield pd.DataFrame({"batch_id": pdf["batch_id"].values, "reply": [r for r, _ in asked],
                                "error": [e for _, e in asked]})

    return todo.mapInPandas(run, "batch_id bigint, reply string, error string")


SingleLabeller = Callable[[list[dict]], str]


def rule_single_labeller(messages_: list[dict]) -> str:
    """Deterministic stand-in for the single-text call: answers ``tone <n>`` for
    the user text, wrapped in a reasoning block when the text length is odd."""
    text = messages_[-1]["content"][len("Text: "):]
    n = len(text)
    label = f"tone {n % 7}"
    return f"<think>{n}</think>{label}" if n % 2 == 1 else label


def label_each(texts: DataFrame, labeller: SingleLabeller = rule_single_labeller,
               settings: TagSettings = DEFAULTS.tags, retries: int = 2, pause_s: float = 0.0,
               calls_per_s: float | None = None, width: int = 8) -> DataFrame:
    """Single-text form (L2-L4, L7): ``(ord, label, error)`` - one call per text.

    The reply's reasoning block is cut (second piece after the flag); a failed
    call leaves the label NULL and fills ``error`` (never an apology as label).
    Runs as ``mapInPandas`` over Arrow batches; texts are independent rows. ``pause_s``, ``calls_per_s`` and
    ``width`` are those of :func:`call_labeller`.
    """
    todo, pause = _budgeted(texts.select("ord", "text"), pause_s, calls_per_s, width)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pace = Pace(pause)
        for pdf in it:
            asked = [_ask(lambda: labeller(single_prompt(t or "")), pace, retries) for t in pdf["text"].values]
            yield pd.DataFrame({"ord": pdf["ord"].values, "reply": [r for r, _ in asked],
                                "error": [e for _, e in asked]})

    out = todo.mapInPandas(run, "ord bigint, reply string, error string")
    return out.select("ord", strip_reasoning("reply", settings.reasoning_flag).alias("label"), "error")


def prompt_key(prompt: str = "prompt") -> F.Column:
    """A reply belongs to what was asked, not to a position: the md5 of the prompt."""
    return F.md5(F.col(prompt))


def read_store(spark, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """A stored table, or an empty one where nothing has been written; other errors are raised."""
    try:
        return spark.read.format(fmt).schema(schema).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def store_replies(replies_to_run: Callable[[DataFrame], DataFrame], prompts: DataFrame,
                  path: str) -> DataFrame:
    """Reply store keyed by the prompt's content; ``(batch_id, reply, error)`` of ``prompts``.

    Only prompts without a successful reply under ``path`` are sent to the
    labeller (left anti join), so a rerun repeats no paid call, failed calls
    are tried again, and another corpus on the same path gets no stale reply.
    Equal prompts are sent once. :func:`textlab.operators.replies.compact` keeps the store small.
    """
    spark = prompts.sparkSession
    keyed = cut_lineage(prompts.select("batch_id", prompt_key().alias("prompt_key")))   # the long columns stay behind
    known = reply_store.stored(spark, path)
    done = known.where(F.col("error").isNull()).select("prompt_key").distinct()
    last = known.agg(F.max("run")).first()[0] or 0
    todo = keyed.join(done, "prompt_key", "left_anti")
    once = cut_lineage(todo.groupBy("prompt_key").agg(F.min("batch_id").alias("batch_id")))
    new = replies_to_run(prompts.join(broadcast_measured(once.select("batch_id")), "batch_id", "left_semi"))
    reply_store.append(new.join(once, "batch_id")
                       .select("prompt_key", "reply", "error", F.lit(last + 1).alias("run")), path)
    kept = reply_store.best(reply_store.stored(spark, path)).select("prompt_key", "reply", "error")
    return keyed.join(kept, "prompt_key").select("batch_id", "reply", "error")


# ---------------------------------------------------------------- L4 / L5
def parse_replies(replies: DataFrame, settings: TagSettings = DEFAULTS.tags) -> tuple[DataFrame, DataFrame]:
    """L4 + L5: ``labels(batch_id, idx, label)`` and ``quarantine(batch_id, line_no, line, reason)``.

    Reasoning is cut at the flag (second piece if present); lines without ``:``
    are ignored; the index is the stripped text before the first ``:``; on a
    repeated index the last line wins. Lines whose index is not an integer go
    to quarantine instead of failing the batch.
    """
    clean = replies.where(F.col("reply").isNotNull()).select(
        "batch_id", strip_reasoning("reply", settings.reasoning_flag).alias("clean"))
    lines = clean.select("batch_id", F.posexplode(F.split("clean", "\n", -1)).alias("line_no", "line"))
    lines = lines.where(F.instr("line", ":") > 0)
    colon = F.instr("line", ":")
    parsed = lines.select(
        "batch_id", "line_no", "line",
        strip_keep_null(F.substring_index("line", ":", 1)).try_cast("int").alias("idx"),
        strip_keep_null(F.col("line").substr(colon + 1, F.length("line"))).alias("label"),
    )
    labels = parsed.where(F.col("idx").isNotNull()).groupBy("batch_id", "idx").agg(
        F.max_by("label", "line_no").alias("label"))
    quarantine = parsed.where(F.col("idx").isNull()).select(
        "batch_id", "line_no", "line", F.lit("bad_index").alias("reason"))
    return labels, quarantine


# ---------------------------------------------------------------- L6 / L7
def align(batched: DataFrame, labels: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """L6 (+L7): every text with its label by key ``(batch_id, idx)``.

    ``(ord, batch_id, idx, label, error)``; texts without a parsed label keep
    NULL; ``error`` carries the batch's call failure when there was one.
    """
    out = batched.select("ord", "batch_id", "idx").join(labels, ["batch_id", "idx"], "left")
    if replies is not None:
        out = out.join(replies.select("batch_id", "error"), "batch_id", "left")
    else:
        out = out.withColumn("error", F.lit(None).cast("string"))
    return out


def out_of_range(batched: DataFrame, labels: DataFrame) -> DataFrame:
    """Parsed labels whose index names no text of the batch (quarantine)."""
    return labels.join(batched.select("batch_id", "idx"), ["batch_id", "idx"], "left_anti") \
                 .withColumn("reason", F.lit("index_out_of_range"))


# ---------------------------------------------------------------- L8 / L9
def validate(labelled: DataFrame, settings: TagSettings = DEFAULTS.tags) -> DataFrame:
    """Adds ``n_words, valid, reason`` against the label contract."""
    lab = strip_keep_null(F.col("label"))
    n_words = F.when(lab == "", F.lit(0)).otherwise(F.size(F.split(lab, r"\s+")))
    reason = (F.when(F.col("label").isNull(), F.lit("missing"))
               .when(lab == "", F.lit("empty"))
               .when(F.col("label").rlike("[\\r\\n]"), F.lit("multiline"))
               .when(n_words > settings.max_label_words, F.lit("too_many_words"))
               .when(F.lower(lab).isin(*GENERIC_LABELS), F.lit("generic")))
    return labelled.withColumn("n_words", n_words.cast("int")) \
                   .withColumn("reason", reason) \
                   .withColumn("valid", F.col("reason").isNull())


def label_freq(labelled: DataFrame) -> DataFrame:
    """``(label, n)`` over non-NULL labels."""
    return labelled.where(F.col("label").isNotNull()).groupBy("label").agg(
        F.count(F.lit(1)).alias("n"))


def tag(docs: DataFrame, labeller: Labeller = rule_labeller,
        settings: TagSettings = DEFAULTS.tags, dense: bool = True) -> dict[str, DataFrame]:
    """L1-L7 chained: returns ``batched, prompts, replies, labels, quarantine, aligned``."""
    batched = assign_batches(docs, settings, dense)
    prompts = build_prompts(batched)
    # replies are used twice (labels and errors): materialise them so every
    # batch is sent to the labeller exactly once
    replies = cut_lineage(call_labeller(prompts, labeller))
    labels, quarantine = parse_replies(replies, settings)
    aligned = align(batched, labels, replies)
    return {"batched": batched, "prompts": prompts, "replies": replies,
            "labels": labels, "quarantine": quarantine, "aligned": aligned}
