"""Brute-force versions and small inputs of the corpus operators' tests."""

import glob
import os

import duckdb

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(name, columns, sf=SMALL):
    path = f"{sf}/{name}.parquet"
    path = path + "/*.parquet" if os.path.isdir(path) else path
    assert glob.glob(path)
    return duckdb.sql(f"select {columns} from '{path}'").fetchall()


def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows and ties; clashing extra columns."""
    long = " ".join(f"w{i % 97}x{i % 13}" for i in range(30_000))
    rows = [(1, None, "en", "a", None), (2, "", None, "a", 0), (3, " \n\t ", "en", None, 3), (4, "one two", "de", "b", 7),
            (4, "one two", "de", "b", 7), (None, "no id here at all, none. None!", "en", "b", 1), (None, None, None, None, None),
            (5, "one two", None, "a", 7), (6, long, "en", "a", len(long)), (7, long, "en", "b", len(long)),
            (7, "other text of the same id", "en", "b", 1), (8, "日本語 é ñ ß — 12 % $$", "xx", "c", 9),
            (9, "y" * 3000, "en", "c", 3000)]
    names = "size long, Score double, copies string, fingerprint string, ids int"
    return spark.createDataFrame([(*r, 1, 2.0, "c", "f", 3) for r in rows], f"{DOCS}, {names}")


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)
