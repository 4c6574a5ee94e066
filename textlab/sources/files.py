"""Sources and sinks (S1, S3-S7) with explicit schemas - no inference."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textlab.functions.text import PY_WHITESPACE
from textlab.operators.common import broadcast_measured, cut_lineage
from textlab.operators.tagging import read_store

_WS_CLASS = "[" + "".join(f"\\u{ord(c):04x}" for c in PY_WHITESPACE) + "]"


def _order_key(df: DataFrame) -> DataFrame:
    """File order (file name, position in the file) as a dense 0-based ``ord``.

    Rows stay where they are read: a first scan counts the rows of each file
    split, the splits' starts (one row per split) are broadcast, and a row's
    ``ord`` is its split's start plus its place there. No text is shuffled.
    """
    placed = df.select("*", F.input_file_name().alias("_file"),
                       F.expr("input_file_block_start()").alias("_block"),
                       F.monotonically_increasing_id().alias("_pos"))
    splits = placed.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut_lineage(splits.select("_file", "_block", "_first",
                                       F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    return placed.join(broadcast_measured(starts), ["_file", "_block"]) \
        .withColumn("ord", F.col("_start") + F.col("_pos") - F.col("_first")) \
        .drop("_file", "_block", "_pos", "_first", "_start")


_CSV = {"multiLine": True, "escape": '"'}
# Outside quoted fields a quote stands next to a separator, an end or another quote; pairs are reduced to one first.
_STRAY = '[^",]"|"[^",]'


def _split_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row a file split: is its number of quotes odd, and how many records start
    in it if it starts outside (``_even``) or inside (``_odd``) a quoted field."""
    seen: dict[tuple, list[int]] = {}
    for pdf in batches:
        for key, part in pdf.groupby(["_file", "_block"], sort=False):
            state = seen.setdefault(key, [0, 0, 0])
            quote = part["_quote"].to_numpy(dtype=np.int64)
            full = ~part["_blank"].to_numpy(dtype=bool)
            inside = (state[0] + np.cumsum(quote) - quote) % 2 == 1
            state[0] = int(state[0] + quote.sum()) % 2
            state[1] += int((full & ~inside).sum())
            state[2] += int((full & inside).sum())
    yield pd.DataFrame([(*key, *counts) for key, counts in seen.items()],
                       columns=["_file", "_block", "_flips", "_even", "_odd"])


def _assemble(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of splits, in order, to records ``(_s, _seq, _at, _whole, record)``.

    A record that goes on in later splits comes in pieces under the split and number where it
    starts; ``_at`` is the piece's own split. Holds the lines of one open record besides a batch.
    """
    split, inside, seq, held, owner = None, 0, 0, [], None
    out: list[tuple] = []

    def leave() -> None:
        if held:
            out.append((*(owner or (split, seq)), split, False, "\n".join(held)))
            held.clear()

    for pdf in batches:
        for s, part in pdf.groupby("_s", sort=False):
            if s != split:
                leave()
                split, inside, seq = s, int(part["_inside"].iloc[0]), 0
                owner = (int(part["_owner"].iloc[0]), int(part["_owner_seq"].iloc[0])) if inside else None
            quote = part["_quote"].to_numpy(dtype=np.int64)
            after = (inside + np.cumsum(quote)) % 2
            lines = part["value"].to_numpy()
            begin = 0
            for end in np.flatnonzero(after == 0) + 1:
                held.extend(lines[begin:end])
                begin = end
                if owner is not None:
                    leave()
                    owner = None
                elif len(held) > 1 or held[0] not in ("", "\r"):
                    out.append((split, seq, split, True, "\n".join(held)))
                    seq += 1
                held.clear()
            held.extend(lines[begin:])
            inside = int(after[-1])
        yield pd.DataFrame(out, columns=["_s", "_seq", "_at", "_whole", "record"])
        out.clear()
    leave()
    yield pd.DataFrame(out, columns=["_s", "_seq", "_at", "_whole", "record"])


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of CSV files with quoted newlines, each file read by many tasks: its columns and ``ord``.

    Files are read as lines in byte ranges. A line starts a record where the quotes before it in
    its file are even in number, so a first pass counts the quotes of each range and the second
    knows how a range begins. A record across ranges is put together from its pieces, of which a
    range has two at most; records within one are not shuffled. Blank lines between records are skipped, line ends inside quotes
    are kept. This holds where a quote in a field is doubled and the field quoted; any other record (``5" disk``) is an
    error, never a wrong row, and such files are read with ``whole_files=True``.
    """
    schema = spark.read.csv(path, header=True, inferSchema=False, **_CSV).schema
    raw = spark.read.option("lineSep", "\n").text(path).select(
        F.input_file_name().alias("_file"), F.expr("input_file_block_start()").alias("_block"),
        F.monotonically_increasing_id().alias("_pos"), "value",
        ((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2).alias("_quote"))
    counts = raw.select("_file", "_block", "_quote", F.col("value").isin("", "\r").alias("_blank")) \
        .mapInPandas(_split_counts, "_file string, _block bigint, _flips int, _even bigint, _odd bigint")

    # one row a split from here on
    order = Window.orderBy("_file", "_block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = counts.withColumn("_inside", F.coalesce(F.sum("_flips").over(in_file), F.lit(0)) % 2) \
        .withColumn("_n", F.when(F.col("_inside") == 0, F.col("_even")).otherwise(F.col("_odd"))) \
        .withColumn("_head", ((F.col("_n") > 0) & (F.coalesce(F.sum("_n").over(in_file), F.lit(0)) == 0)).cast("int")) \
        .withColumn("_s", F.row_number().over(order)) \
        .withColumn("_start", F.coalesce(F.sum(F.col("_n") - F.col("_head")).over(earlier), F.lit(0)))
    begun = F.when(F.col("_n") > 0, F.struct("_s", (F.col("_n") - 1).alias("seq")))
    splits = splits.withColumn("_from", F.last(begun, ignorenulls=True).over(earlier)) \
        .select("_file", "_block", "_s", "_inside", "_start", "_head",
                F.col("_from._s").alias("_owner"), F.col("_from.seq").alias("_owner_seq"),
                ((F.col("_inside") + F.col("_flips")) % 2 + F.col("_inside") > 0).alias("_cut"))
    splits = cut_lineage(splits)

    def parts(of: DataFrame) -> DataFrame:
        side = broadcast_measured(of)
        lines = raw.join(side, ["_file", "_block"])
        if side is of:   # too many splits to broadcast: the join does not keep the order of lines
            lines = lines.repartition("_s").sortWithinPartitions("_s", "_pos")
        return lines.select("_s", "_inside", "_owner", "_owner_seq", "_quote", "value").mapInPandas(
            _assemble, "_s int, _seq bigint, _at int, _whole boolean, record string")

    records = parts(splits).where("_whole").select("_s", "_seq", "record")
    if not splits.where("_cut").isEmpty():
        pieces = parts(splits.where("_cut")).where("NOT _whole").groupBy("_s", "_seq").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "record"))),
                                     lambda x: x["record"]), "\n").alias("record"))
        records = records.unionByName(pieces)
    place = splits.select("_s", "_start", "_head")
    rows = records.join(broadcast_measured(place), "_s").where(F.col("_seq") >= F.col("_head"))
    stray = F.regexp_replace("record", '"[^"]*+"', '"').rlike(_STRAY)
    record = F.when(~stray, F.regexp_replace("record", "\\r\\z", "")).otherwise(F.raise_error(F.lit(
        f"{path}: a quote inside an unquoted field; read it with whole_files=True")))
    row = F.from_csv(record, ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema), _CSV | {"multiLine": "true"})
    return rows.select(row.alias("_row"), (F.col("_start") + F.col("_seq") - F.col("_head")).alias("ord")).select(
        *[F.col("_row")[f.name].alias(f.name) for f in schema if f.name != "ord"], "ord")


def _is_csv(path: str) -> bool:
    return os.path.splitext(path.rstrip("/"))[1].lower() == ".csv"


def read_table(spark: SparkSession, path: str, multiline: bool = True, whole_files: bool = False) -> DataFrame:
    """Read a CSV (header, quoted newlines, doubled quotes) or Parquet table.

    Every CSV column is read as a string (the text is kept as written: no
    number re-formatting). The extension is compared lower-cased; Excel and
    anything else raise. Big CSV files are read by many tasks (:func:`csv_records`); ``whole_files``
    reads each in one, with stray quotes allowed. ``multiline=False`` breaks records whose text holds a newline.
    """
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext == ".csv":
        if multiline and not whole_files:
            return csv_records(spark, path).drop("ord")
        return spark.read.csv(path, header=True, multiLine=multiline, escape='"', inferSchema=False)
    if ext in (".parquet", ""):
        return spark.read.parquet(path)
    raise ValueError(f"unsupported file type {ext!r}: only CSV or Parquet tables are read")


def read_texts(spark: SparkSession, path: str, column: str = "text", keep_all: bool = False,
               null_text: str | None = None, multiline: bool = True, whole_files: bool = False) -> DataFrame:
    """``(ord, text[, other columns])`` with ``ord`` the dense file order.

    S1 keeps only the text column; S3 (``keep_all``) keeps every column. A
    missing column is an error naming it. NULL stays NULL unless ``null_text``
    (e.g. ``"nan"``) is given.
    """
    numbered = _is_csv(path) and multiline and not whole_files
    df = csv_records(spark, path) if numbered else read_table(spark, path, multiline, whole_files)
    if column not in df.columns:
        raise ValueError(f"column {column!r} not found; columns are {[c for c in df.columns if c != 'ord']}")
    text = F.col(column).cast("string")
    if null_text is not None:
        text = F.coalesce(text, F.lit(null_text))
    out = df.withColumn("text", text)
    if not keep_all:
        out = out.select("text", *["ord"] * numbered)
    return out if numbered else _order_key(out)


def read_word_vectors(spark: SparkSession, path: str, vocab: DataFrame, dim: int = 300) -> DataFrame:
    """``(word, vec ARRAY<FLOAT>)`` for vocabulary words from a word-vector text file.

    Lines are stripped; blank lines and a two-integer header are skipped; rows
    whose width is not ``dim`` are dropped; only vocabulary words are kept
    (left semi join, the vocabulary broadcast if its measured size allows);
    when a word repeats, the last line wins. Bytes that aren't UTF-8 are dropped.
    """
    value = F.translate(F.make_valid_utf8("value"), "\ufffd", "")
    lines = spark.read.text(path).select(
        F.struct(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i")).alias("line_no"),
        F.trim(value, F.lit(PY_WHITESPACE)).alias("line"))
    parts = lines.where(F.col("line") != "").select("line_no", F.split("line", _WS_CLASS + "+").alias("p"))
    is_header = (F.size("p") == 2) & F.element_at("p", 1).rlike("^[+-]?[0-9]+$") & \
        F.element_at("p", 2).rlike("^[+-]?[0-9]+$")
    rows = parts.where(~is_header).select(
        "line_no", F.element_at("p", 1).alias("word"), F.slice("p", 2, 1 << 30).alias("v"))
    rows = rows.where(F.size("v") == dim)
    words = broadcast_measured(vocab.select("word"))
    rows = rows.join(words, "word", "left_semi")
    vec = F.transform("v", lambda x: x.try_cast("float"))
    rows = rows.select("word", "line_no", vec.alias("vec")).where(
        F.forall("vec", lambda x: x.isNotNull()))
    return rows.groupBy("word").agg(F.max_by("vec", "line_no").alias("vec"))


def write_vectors(vecs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One Parquet table ``(ord, <meta>, embedding ARRAY<FLOAT>)`` - no positional sidecar."""
    out = vecs.withColumn("embedding", F.transform("vec", lambda x: x.cast("float"))).drop("vec")
    out.write.mode(mode).parquet(path)


def write_labels(aligned: DataFrame, path: str, run_id: str) -> None:
    """Labels as JSON lines keyed by ``(run_id, batch_id, idx)``; batches already
    present under ``path`` for this run are skipped (left anti join)."""
    new = aligned.withColumn("run_id", F.lit(run_id))
    schema = new.schema.simpleString()[len("struct<"):-1].replace(":", " ")
    done = read_store(aligned.sparkSession, path, schema, "json") \
        .where(F.col("run_id") == run_id).select("batch_id").distinct()
    new.join(done, "batch_id", "left_anti").write.mode("append").json(path)


def read_label_array(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of strings -> ``(ord, label)`` in array order (one task per file)."""
    whole = spark.read.text(path, wholetext=True)   # the array format is not splittable
    arr = F.from_json(F.col("value"), "array<string>")
    return whole.select(F.posexplode(arr).alias("ord", "label")) \
                .select(F.col("ord").cast("bigint").alias("ord"), "label")
