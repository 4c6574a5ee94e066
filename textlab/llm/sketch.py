"""Document fingerprints: threshold-scaled sketches of word shingles (operator 6, native).

A sketch holds every shingle hash below a fixed part of the hash space, so the
shares that two sketches have in common estimate likeness and containment
however unequal the texts are. So that no text with a word has an empty sketch,
the smallest hash of a text without any below the threshold is kept; it alone
lies above. The sketch of a union of texts' shingles is thus the union of their
sketches without such hashes, or the smallest if there are no others
(:func:`merged`). Words are lower-cased; a shingle is SHINGLE words, a text with
fewer words is one shingle.

A fingerprint is the sketch's hashes in order, 12 hexadecimal digits each.

Cases: a null text is the empty text; one without a word has the empty
fingerprint, whose likeness to another empty one is 1, to any other 0.
Documents follow by falling id, null last, equal ids by the hash of their
text; the last is followed by the first. Rows equal in id and text are one
document there, and each gets its result. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.llm.common import in_order

SHINGLE, PART, BITS = 5, 4, 48
#: Hashes below are kept.
LIMIT = (1 << BITS) // PART
_SPACE = " \t\n\x0b\f\r"


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the sketch of a text column: sorted distinct 48-bit hashes."""
    words, hashes, grams = f"__{name}_w", f"__{name}_h", f"__{name}_g"
    out = df.withColumn(words, F.split(F.btrim(F.lower(F.col(text)), F.lit(_SPACE)), r"[\x20\x09-\x0D]+"))
    out = out.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    run = F.transform(F.sequence(F.lit(0), F.size(hashes) - SHINGLE), lambda i: F.shiftrightunsigned(
        F.xxhash64(*[F.get(F.col(hashes), i + k) for k in range(SHINGLE)]), 64 - BITS))
    out = out.withColumn(grams, F.when(F.length(F.btrim(F.col(text), F.lit(_SPACE))) == 0, F.array().cast("array<bigint>"))
                         .when(F.size(hashes) < SHINGLE, F.array(F.shiftrightunsigned(F.xxhash64(hashes), 64 - BITS)))
                         .otherwise(run))
    kept = F.filter(grams, lambda g: g < F.lit(LIMIT))
    least = F.when(F.size(grams) > 0, F.array(F.array_min(grams))).otherwise(F.array().cast("array<bigint>"))
    return out.withColumn(name, F.sort_array(F.array_distinct(F.concat(kept, least)))).drop(words, hashes, grams)


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda g: F.lpad(F.lower(F.hex(g)), BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Shares of shingles in both of all in either."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def merged(a: Column, b: Column) -> Column:
    """The sketch of all shingles of two texts from their sketches."""
    both = F.array_sort(F.array_union(a, b))
    below = F.filter(both, lambda h: h < F.lit(LIMIT))
    return F.when(F.size(below) > 0, below).otherwise(F.slice(both, 1, 1))


def containment(a: Column, b: Column) -> Column:
    """Shares of a's shingles that are in b."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, sketch, head, next): the next document's beginning, half as long as the text, and sketch.

    Only ids, text hashes and lengths are put in order. Texts are shuffled once
    by (id, hash); from there each sends its beginning and its sketch to the
    document before it.
    """
    keys = ["key", "none", "hash"]  # of a row: its id (null: 0 and none), and its text's hash
    base = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(doc_id), F.lit(0)).alias("key"),
                       F.col(doc_id).isNull().alias("none")).withColumn("hash", F.xxhash64("text"))
    known = base.groupBy(*keys, F.length("text").alias("n")).agg(F.lit(1).alias("one"))
    order = in_order(known.drop("one"), [F.col("none"), F.col("key").desc(), F.col("hash")], "at")
    count = order.count()
    after = order.select(F.pmod(F.col("at") + 1, F.lit(max(1, count))).alias("at"),
                         *[F.col(k).alias(f"to_{k}") for k in keys], F.floor(F.col("n") / 2).cast("int").alias("half"))
    route = order.join(after, "at").select(*keys, *[f"to_{k}" for k in keys], "half")
    # both joins read these columns by these keys, so the texts are shuffled once
    dealt = base.repartition(*keys)
    once = F.row_number().over(Window.partitionBy(*keys).orderBy("hash"))
    sender = dealt.join(route, keys).withColumn("copy", once).where("copy = 1")
    sent = with_sketch(sender, "text", "next").select(
        *[F.col(f"to_{k}").alias(k) for k in keys], F.expr("substring(text, 1, half)").alias("head"), "next")
    whole = dealt.join(sent, keys).withColumn("id", F.when(~F.col("none"), F.col("key")))
    return with_sketch(whole.drop(*keys), "text", "sketch")


def compare(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness to one another and the next text's."""
    n = F.length("text")
    edited = with_next(docs, doc_id, text).withColumn("n_chars", n.cast("long")).withColumn(
        "edited", F.concat(F.expr("substring(text, 1, length(text) - int(floor(length(text) / 2)))"), "head"))
    both = with_sketch(edited, "edited", "edited_sketch")
    return both.select(
        F.col("id").alias(doc_id), "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("sketch"), F.col("next")).alias("near_next"),
        containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_within"),
        containment(F.col("sketch"), F.col("next")).alias("within_next"))
