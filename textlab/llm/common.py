"""Helpers shared by the operators of this package.

Conventions used by every operator
----------------------------------
* Rows are never lost: a null text counts as the empty text, a null id is a
  value like any other (joins on ids are null-safe), repeated rows each get
  their result, empty tables give empty results of the same schema.
* Extra input columns pass through. Where an input column has the name of a
  result column (in any case), the result replaces it.
* Working columns start with ``__`` so that they don't meet input columns.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from textlab.operators.common import cut_lineage, lookup
from textlab.session import scratch_path

#: White space that separates words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
#: Most bytes that a checked broadcast may have.
BROADCAST_BYTES = 32 << 20
#: Rows of an Arrow batch that are worked on at a time.
SLICE = 64


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df without the columns of these names, in any case."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores after it until no column of df has it, in any case."""
    low = {c.lower() for c in df.columns}
    while name.lower() in low:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet under the shared checkpoint folder, and read back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def add_columns(df: DataFrame, inputs: Sequence[str], fields: Sequence[T.StructField],
                make: Callable[[], Callable[..., list]], drop: Sequence[str] = ()) -> DataFrame:
    """df with ``fields`` added by a function over Arrow arrays of ``inputs``.

    ``make`` runs once a task and returns the function; it gets slices of at
    most SLICE rows and returns one array for each field. Columns in ``drop``
    (say a text no longer needed) don't go back to the JVM.
    """
    gone = {f.name.lower() for f in fields} | {d.lower() for d in drop}
    keep = [f for f in df.schema.fields if f.name.lower() not in gone]
    schema = T.StructType([*keep, *fields])
    names = [f.name for f in keep]
    order = {c: i for i, c in enumerate(df.columns)}
    inputs_at = [order[c] for c in inputs]
    keep_at = [order[c] for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                new = work(*[part.column(i) for i in inputs_at])
                old = [part.column(i) for i in keep_at]
                arrays = [a if a.type == f.type else a.cast(f.type)
                          for a, f in zip([*old, *new], arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)
        tidy()

    return df.mapInArrow(run, schema)


def tidy() -> None:
    """Give memory that is no longer used back to the system: idle Python workers live on for other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def utf8_slices(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and its n+1 offsets; null: empty."""
    column = column.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    if not len(column) or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[bounds[0]:bounds[-1]]
    return data, bounds - bounds[0]


def in_order(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """df, written once, with its dense number from 0 in ``order`` as ``name``.

    Range partitions are sorted, each row keeps its partition and its place
    there, and the partitions' starts (a row each, broadcast) are added.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(
        df.repartitionByRange(n, *order).sortWithinPartitions(*order).select(
            "*", F.spark_partition_id().alias("__part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__place")),
        "ordered")
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), "__part") \
        .withColumn(name, F.col("__start") + F.col("__place")).drop("__part", "__place", "__start")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the ends of links (a, b): root is the smallest node reachable.

    Alternating stars: every node links its larger neighbours to the smallest
    node around it, then its smaller ones, until only stars around the roots
    are left; rounds grow with the logarithm of the longest path. A node's
    smallest neighbour is aggregated before the shuffle, and the links of a
    node with very many don't meet in one task (see lookup). Every round is
    written to the checkpoint folder.
    """
    both = lambda e: e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
    least = lambda e: cut_lineage(
        e.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n")))
    spread = F.xxhash64("a", "b")
    links = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .where("a <> b").distinct())
    total = links.count()
    while total:
        near = least(both(links)).select("a", F.least("a", "low").alias("low"), "n")
        large = lookup(both(links), near, "a", "n", spread, 2 * total) \
            .where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        star = cut_lineage(large.distinct())
        near = least(star)
        small = lookup(star, near, "a", "n", spread, total).where("b <> low") \
            .select(F.col("b").alias("a"), F.col("low").alias("b"))
        after = cut_lineage(small.union(near.select("a", F.col("low").alias("b"))).distinct())
        before, total = total, after.count()
        if before == total and links.exceptAll(after).isEmpty():
            break
        links = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def sample_of_each(rows: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """Of each value of group the rows (about) of the smallest hash of key, at most ``most``.

    A hash threshold of twice the share needed comes first, so a value that
    holds most rows sends no more than about 2*most of them to its task.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    share = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = rows.join(F.broadcast(sizes), group).where(share <= F.lit(2.0 * most) / F.col("__n")).drop("__n")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.pmod(F.xxhash64(key), F.lit(1 << 30)), key))
    return few.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")
