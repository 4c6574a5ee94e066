"""Shared physical helpers: global ordinals, size-checked broadcast, lineage cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textlab.session import ensure_checkpoint_dir, scratch_path

# Largest side we broadcast on a proven row bound (rows x bytes/row checked).
BROADCAST_BYTES_LIMIT = 64 * 1024 * 1024

_LOW33 = (1 << 33) - 1


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared ``spark.checkpoint.dir`` (never local)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under the shared checkpoint folder, and read back.

    For tables as long as the corpus: a checkpoint keeps whole uncompressed rows.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_bounded(df: DataFrame, max_rows: int, row_bytes: int,
                         limit: int = BROADCAST_BYTES_LIMIT) -> DataFrame:
    """Broadcast hint only when ``max_rows * row_bytes`` is a proven fit.

    ``max_rows`` must be a bound known from the parameters (vocabulary cap, k
    centres, partition count), not an estimate. Beyond the limit the join is
    left to Catalyst/AQE (sort-merge, or a runtime broadcast if AQE sees it fit).
    """
    if max_rows * row_bytes <= limit:
        return F.broadcast(df)
    return df


def with_ordinal(df: DataFrame, order_cols: list[Column | str], name: str = "rn",
                 num_partitions: int | None = None) -> DataFrame:
    """Add a dense 1-based ordinal in ``order_cols`` order without a global window.

    Rows are range-partitioned and sorted within partitions; each row gets its
    partition id and its index inside the partition (low 33 bits of
    ``monotonically_increasing_id``). The tagged frame is checkpointed so the
    per-partition counts and the rows agree; partition offsets (one row per
    partition, a proven bound) are broadcast. Order keys must be unique.
    """
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    tagged = ordered.select(
        "*",
        F.spark_partition_id().alias("_pid"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW33)).alias("_local"),
    )
    tagged = cut_lineage(tagged)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition: a single-partition window over <= n rows is bounded
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    out = tagged.join(broadcast_if_bounded(offsets, n, 16), "_pid")
    return out.withColumn(name, (F.col("_off") + F.col("_local") + F.lit(1)).cast("bigint")) \
              .drop("_pid", "_local", "_off")


def broadcast_measured(df: DataFrame, limit: int = BROADCAST_BYTES_LIMIT) -> DataFrame:
    """Broadcast hint after measuring ``df`` (rows and bytes of its strings and arrays).

    For materialised frames only: it runs one small aggregate over them.
    """
    sizes = [F.octet_length(F.col(f"`{c}`")) if t == "string" else F.size(F.col(f"`{c}`")) * 8
             for c, t in df.dtypes if t == "string" or t.startswith("array")]
    row = F.lit(48 + 16 * len(df.columns))
    for x in sizes:
        row = row + F.coalesce(x, F.lit(0))
    total = df.agg(F.sum(row.cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


# A key with more than 1/HOT_PARTS of the rows (and over HOT_ROWS) is hot.
HOT_PARTS, HOT_ROWS = 1000, 10_000


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, spread: Column,
           total: int) -> DataFrame:
    """``left`` with the columns of ``right`` for its key; NULL where there is none.

    ``right`` has one row per key and says in ``weight`` how many rows of
    ``left`` have it, ``total`` how many there are in all. A key with more than
    total / HOT_PARTS of them is hot; fewer than HOT_PARTS keys can be, so those are
    broadcast and their rows are dealt by ``spread`` (same type as the key)
    instead of the key: no task gets all rows of a hot key.
    """
    most = max(HOT_ROWS, (total or 0) // HOT_PARTS)
    values = [c for c in right.columns if c not in (key, weight)]
    hot = right.where(F.col(weight) > most).select(
        F.col(key), *[F.col(c).alias(f"__hot_{c}") for c in values], F.lit(True).alias("__hot"))
    cold = right.where(F.col(weight) <= most).select(
        F.col(key).alias("__key"), *[F.col(c).alias(f"__cold_{c}") for c in values],
        F.lit(False).alias("__is_hot"))
    marked = left.join(F.broadcast(hot), key, "left") \
        .withColumn("__is_hot", F.col("__hot").isNotNull()) \
        .withColumn("__key", F.when(F.col("__is_hot"), spread).otherwise(F.col(key)))
    found = marked.join(cold, ["__key", "__is_hot"], "left")
    return found.select(*[F.col(f"`{c}`") for c in left.columns],
                        *[F.when(F.col("__is_hot"), F.col(f"__hot_{c}"))
                          .otherwise(F.col(f"__cold_{c}")).alias(c) for c in values])
