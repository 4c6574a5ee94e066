"""Corpus identity and projections.

The canonical corpus frame is ``docs(ord BIGINT, text STRING, ...)`` where
``ord`` is the dense 0-based position of the text in its corpus; identity
never rests on row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlab.functions.text import strip_text
from textlab.operators.common import broadcast_measured, cut_lineage, lookup, with_ordinal

# Rows folded into one digest per level of the fingerprint tree. A group holds
# at most this many 32-character digests (about 2 MB), whatever the corpus size.
FINGERPRINT_FANOUT = 65536


def as_docs(df: DataFrame, key: str, text: str = "text", dense: bool = False) -> DataFrame:
    """Project any table to ``(ord, text, <other cols>)``.

    ``dense=True`` re-numbers ``key`` to a gap-free 0-based ordinal (distributed,
    see :func:`with_ordinal`); otherwise ``key`` must already be dense.
    """
    if dense:
        ranked = with_ordinal(df.select(key), [key], name="_rn")
        df = df.join(ranked, key).withColumn("ord", F.col("_rn") - 1).drop("_rn")
    else:
        df = df.withColumn("ord", F.col(key).cast("bigint"))
    if text != "text":
        df = df.withColumnRenamed(text, "text")
    return df


def _ordered_md5(order: str, digest: str):
    """md5 of the digests of one group concatenated in ``order`` order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(digest).alias("d"))))
    return F.md5(F.array_join(F.transform(ordered, lambda x: x["d"]), ""))


def fingerprint(docs: DataFrame, fanout: int = FINGERPRINT_FANOUT) -> DataFrame:
    """Order-sensitive corpus digest, computed as a three-level md5 tree.

    row digest = md5(ord ':' md5(text)); level 1 folds ``fanout`` consecutive
    rows (by ``ord``) into md5 of their concatenated digests, level 2 folds
    ``fanout`` level-1 digests the same way, level 3 folds the level-2 digests.
    Groups are formed by value of ``ord``, so sparse ids make small groups;
    levels are added until one group is left (twice the digits of the largest
    id at most). No group holds more than ``fanout`` digests, so the corpus is never
    gathered in one task; ``["a\\nb"]`` and ``["a","b"]`` differ. One row:
    ``fingerprint, n_docs``.
    """
    return root(group_digests(docs, fanout), fanout)


def group_digests(docs: DataFrame, fanout: int = FINGERPRINT_FANOUT) -> DataFrame:
    """P1, the lowest level of the tree: ``(b, d, n)``, digest and rows of each group of ``fanout`` ids."""
    rows = docs.select(
        F.col("ord"),
        F.md5(F.concat(F.col("ord").cast("string"), F.lit(":"),
                       F.md5(F.coalesce(F.col("text"), F.lit(""))))).alias("d"),
        F.floor(F.col("ord") / F.lit(fanout)).cast("bigint").alias("b"),
    )
    return rows.groupBy("b").agg(_ordered_md5("ord", "d").alias("d"), F.count(F.lit(1)).alias("n"))


def root(groups: DataFrame, fanout: int = FINGERPRINT_FANOUT) -> DataFrame:
    """P1 from the lowest level, stored or new: one row ``fingerprint, n_docs``; no text is read."""
    groups = cut_lineage(groups)      # a row of 40 bytes a group, read for its range and then folded
    low, high = groups.agg(F.min("b"), F.max("b")).first()
    span = max(abs(high or 0), abs(low or 0))
    levels = groups
    deep = 1
    while deep < 2 or span // fanout >= fanout:   # the last fold gets at most about fanout digests
        up = F.floor(F.col("b") / F.lit(fanout)).cast("bigint")
        levels = levels.withColumn("up", up).groupBy("up").agg(
            _ordered_md5("b", "d").alias("d"), F.sum("n").alias("n")).withColumnRenamed("up", "b")
        deep, span = deep + 1, span // fanout
    return levels.agg(_ordered_md5("b", "d").alias("fingerprint"), F.sum("n").cast("bigint").alias("n_docs"))


def changed_groups(old: DataFrame, new: DataFrame, fanout: int = FINGERPRINT_FANOUT) -> DataFrame:
    """Where two corpora differ, from their lowest levels: ``(b, low, high, state, n_old, n_new)``.

    ``low`` to ``high`` are the ids that the group spans, ``state`` is ``added``, ``removed`` or ``changed``;
    equal groups give no row, so work kept by group is done again for these alone.
    """
    j = old.select("b", F.col("d").alias("d_old"), F.col("n").alias("n_old")).join(
        new.select("b", F.col("d").alias("d_new"), F.col("n").alias("n_new")), "b", "full")
    state = F.when(F.col("d_old").isNull(), "added").when(F.col("d_new").isNull(), "removed").otherwise("changed")
    return j.where(~F.col("d_old").eqNullSafe(F.col("d_new"))).select(
        "b", (F.col("b") * fanout).alias("low"), (F.col("b") * fanout + (fanout - 1)).alias("high"),
        state.alias("state"), F.coalesce("n_old", F.lit(0)).alias("n_old"), F.coalesce("n_new", F.lit(0)).alias("n_new"))


def appended(stored: DataFrame, docs: DataFrame, fanout: int = FINGERPRINT_FANOUT) -> DataFrame:
    """The lowest level of a corpus that only grew at its end since ``stored``.

    Groups before the stored corpus' last one are taken over; of ``docs`` only ids from that group on
    are read (a filter on ``ord``, which reaches the scan). Ids are 0 or more.
    """
    last = stored.agg(F.max("b")).first()[0]
    if last is None:
        return group_digests(docs, fanout)
    fresh = group_digests(docs.where(F.col("ord") >= F.lit(last * fanout).cast("bigint")), fanout)
    return stored.where(F.col("b") < last).select("b", "d", "n").unionByName(fresh)


def edited(stored: DataFrame, docs: DataFrame, ids: DataFrame, fanout: int = FINGERPRINT_FANOUT) -> DataFrame:
    """The lowest level after rows with the ids ``ids(ord)`` were edited, added or removed.

    Only the groups of these ids are hashed again; ``ids`` are reduced to groups before they meet ``docs``.
    """
    group = F.floor(F.col("ord") / F.lit(fanout)).cast("bigint").alias("b")
    touched = cut_lineage(ids.select(group).distinct())
    rows = docs.withColumn("b", group).join(broadcast_measured(touched), "b", "left_semi").drop("b")
    return stored.select("b", "d", "n").join(touched, "b", "left_anti").unionByName(group_digests(rows, fanout))


def text_key(text_col: str = "text"):
    return F.md5(F.coalesce(F.col(text_col), F.lit("")))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """P2 (row level): one row per distinct text: ``text_key, rep_ord, n_copies, text``.

    Work that depends only on the text (model calls) runs on this frame and is
    joined back by ``text_key``. count/min/first aggregate partially map-side,
    so a text repeated by a third of the corpus costs no hot reducer.
    """
    return docs.groupBy(text_key().alias("text_key")).agg(
        F.min("ord").alias("rep_ord"),
        F.count(F.lit(1)).alias("n_copies"),
        F.min_by("text", "ord").alias("text"),
    )


def join_back(docs: DataFrame, per_text: DataFrame, cols: list[str], weight: str | None = None) -> DataFrame:
    """Attach results computed once per distinct text to every row with that text.

    ``weight`` names the column of ``per_text`` (a materialised frame) with the
    number of copies: a text that many rows share is then broadcast instead of
    sending all its rows to one task.
    """
    keyed = docs.withColumn("text_key", text_key())
    if weight is None:
        return keyed.join(per_text.select("text_key", *cols), "text_key", "left").drop("text_key")
    total = per_text.agg(F.sum(weight)).first()[0]
    return lookup(keyed, per_text.select("text_key", *cols, weight), "text_key", weight,
                  F.concat(F.lit("#"), F.col("ord").cast("string")), total).drop("text_key")


def register_corpus(registry: DataFrame | None, fp: DataFrame, path: str) -> bool:
    """P2 (corpus level): append the fingerprint to a registry table if absent.

    Returns True when the corpus is new (work must run), False when known.
    """
    new = fp.select("fingerprint", "n_docs")
    if registry is not None:
        new = new.join(registry.select("fingerprint"), "fingerprint", "left_anti")
    is_new = not new.isEmpty()
    if is_new:
        new.withColumn("registered_at", F.current_timestamp()).write.mode("append").parquet(path)
    return is_new


def corpus_size(docs: DataFrame) -> DataFrame:
    """Row count of a corpus (one row)."""
    return docs.agg(F.count(F.lit(1)).alias("n_docs"))


def stripped(docs: DataFrame) -> DataFrame:
    """``str(x).strip()`` semantics; None -> ''."""
    return docs.select("ord", strip_text("text").alias("text"))
