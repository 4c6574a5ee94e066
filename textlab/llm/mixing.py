"""Mixing sources to target weights by systematic sampling (operator 2, native).

The weight of a source and its size give the words that the mix should take
from it. Within a source, the documents lie one after another on a line, each
as long as its expected copies (target over source size); with one random
offset for the source, a document is emitted once for each integer boundary
that it crosses. They lie in the order of their size, so the words taken miss
the target by about the longest document at most, whatever the offset.

Targets are shares of all sizes by weight; a source that would get more than
``most`` times its size stops there, and the excess is shared out by weight
among the others until none is above. The level of that sharing is found by
rounds of one aggregate over the sources, of which only sums come to the driver.

Cases: a null text has size 0, an empty one too; such a document has its
expected copies like any other of its source. A null source is a source of its
own, the last. A source of size 0 has target 0 and takes nothing. Documents of
equal size lie in the order of their ids (null first); equal ids in the order
of the hash of their texts. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlab.llm.common import BROADCAST_BYTES, WORD, cut_lineage, in_order, lookup, written
from textlab.operators.common import broadcast_if_bounded

#: Bytes that a row of the table of sources takes at most, besides the name.
SOURCE_BYTES = 512


def words(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset(source: Column, seed: int) -> Column:
    """The source's offset in [0, 1): 32 bits of a hash of the seed and its name."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """sources (number, source_size) with target: weights repeat along the numbers."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    table = cut_lineage(sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most))
    whole = share * (table.agg(F.sum("source_size")).first()[0] or 0)
    level, met = 0.0, -1
    while True:
        above = F.col("cap") <= F.lit(level) * F.col("weight")
        capped, free, n = table.agg(F.sum(F.when(above, F.col("cap")).otherwise(0)),
                                    F.sum(F.when(above, 0).otherwise(F.col("weight"))),
                                    F.count(F.when(above, 1))).first()
        if n == met or not free:
            break
        met, level = n, (whole - capped) / free
    return table.withColumn("target", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight"))) \
        .drop("weight", "cap")


def copies(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2,
           seed: int = 42, doc_id: str = "doc_id", text: str = "text", source: str = "source",
           carry: bool = False) -> DataFrame:
    """docs with size, source_size, target and copies; without ``carry``, of its columns only id and source.

    Rows go through one range shuffle in the order (source, size, id). With
    ``carry`` they take all their columns along, so that no join by id is
    needed to emit them.
    """
    sized = docs.withColumn("size", words(F.col(text))).withColumn("__text", F.xxhash64(text)) \
        .withColumn("__source", F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n")))
    if not carry:
        sized = written(sized.select(doc_id, source, "__source", "size", "__text"), "sizes")
    placed = in_order(sized, [F.col(source).asc_nulls_last(), F.col("size").desc(), F.col(doc_id), F.col("__text")],
                      "__at")
    by_source = placed.groupBy("__source", source).agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    numbered = in_order(by_source, [F.col(source).asc_nulls_last()], "number")
    aim = cut_lineage(targets(numbered, weights, share, most).select(
        "__source", "__n", "source_size", "target", "__first", offset(F.col(source), seed).alias("__offset")))
    total, count, longest = aim.agg(F.sum("__n"), F.count(F.lit(1)), F.max(F.length("__source"))).first()
    if (count or 0) * (SOURCE_BYTES + 4 * (longest or 0)) <= BROADCAST_BYTES:
        found = placed.join(broadcast_if_bounded(aim.drop("__n"), count or 0, SOURCE_BYTES + 4 * (longest or 0),
                                                 BROADCAST_BYTES), "__source")
    else:
        found = lookup(placed, aim, "__source", "__n", F.concat(F.lit("x"), F.col("__at")), total)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = F.col("__at") - F.col("__first")
    crossed = F.floor((at + 1) * each + F.col("__offset")) - F.floor(at * each + F.col("__offset"))
    return found.withColumn("copies", crossed.cast("long")) \
        .drop("__source", "__at", "__first", "__offset", "__text")


def emit(docs: DataFrame, **how) -> DataFrame:
    """The mix: docs with every row as many times as it is taken, its columns unchanged."""
    hidden = [f"__c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, hidden, strict=True))
    how |= {c: at[how.get(c, c)] for c in ("doc_id", "text", "source")}
    taken = copies(docs.toDF(*hidden), carry=True, **how).where("copies > 0") \
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return taken.select(*[F.col(h).alias(c) for c, h in at.items()])
