"""Line dedup by overlapping three-line windows.

A document's lines (split at ``\\n``, trimmed of spaces, tabs and carriage
returns; blank ones are passed over) form windows of three consecutive lines.
A window's key is 128 bits of hash. Windows that occur more than once anywhere
keep their first occurrence, by document id (nulls last) and position; the
lines that any later occurrence covers are removed, the covered stretches
merged. Whole texts are hashed; only keys and positions are shuffled, and the
first occurrence is a minimum that is taken before the shuffle too.

Rows: null text stays null; fewer than three lines are left alone; rows equal
in id and text are one document and get the same decision, rows that share an
id but not the text are different documents; other columns are passed through
in ``row``, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bind, row_key

SIZE = 3
TRIMMED = " \t\r"


def _trim(line: Column) -> Column:
    return F.trim(line, F.lit(TRIMMED))


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _trim), lambda x: x != "")


def windows(docs: DataFrame, text: Column) -> DataFrame:
    """``h1, h2, pos`` of every window, beside the columns of ``docs`` named here."""
    def keys(lines: Column) -> Column:
        starts = F.when(F.size(lines) >= SIZE, F.sequence(F.lit(0), F.size(lines) - SIZE)).otherwise(
            F.array().cast("array<int>"))

        def one(i: Column) -> Column:
            parts = [F.get(lines, i + k) for k in range(SIZE)]
            return F.struct(i.alias("pos"), F.xxhash64(*parts).alias("h1"),
                            F.xxhash64(F.lit("second"), *parts).alias("h2"))
        return F.transform(starts, one)

    spread = docs.select("_id", "_k1", "_k2", F.explode(bind(_lines(text), keys)).alias("w"))
    return spread.select("_id", "_k1", "_k2", "w.pos", "w.h1", "w.h2")


@F.pandas_udf(T.StructType().add("text", "string").add("n_removed", "long"))  # no DDL: a session may not exist yet
def _without(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """The text without the lines that the windows at the given positions cover."""
    for texts, starts in parts:
        out = []
        for text, at in zip(texts, starts, strict=True):
            if at is None:
                out.append((text, 0))
                continue
            gone = {int(p) + k for p in at for k in range(SIZE)}
            kept, n = [], 0
            for line in text.split("\n"):
                if line.strip(TRIMMED):
                    n += 1
                    if n - 1 in gone:
                        continue
                kept.append(line)
            out.append(("\n".join(kept), len(gone)))
        yield pd.DataFrame(out, columns=["text", "n_removed"])


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (the input's columns), ``text`` (cleaned), ``n_lines``, ``n_removed``: one row per input row."""
    docs = df.select(F.struct("*").alias("row"), *row_key(id_col, text_col))
    text = F.col("row")[text_col]
    seen = windows(docs.withColumn("_id", F.col("row")[id_col]), text)
    order = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_k1").alias("k1"),
                     F.col("_k2").alias("k2"), F.col("pos").alias("pos"))
    seen = seen.select("h1", "h2", order.alias("at"))
    first = seen.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first <> last")
    later = seen.join(first.drop("last"), ["h1", "h2"]).where("at <> first")
    removed = later.groupBy(F.col("at.k1").alias("_k1"), F.col("at.k2").alias("_k2")).agg(
        F.collect_set("at.pos").alias("_at"))
    joined = docs.join(removed, ["_k1", "_k2"], "left")
    touched = F.col("_at").isNotNull()
    cleaned = joined.withColumn("_c", _without(F.when(touched, text), F.col("_at")))
    return cleaned.select("row", F.when(touched, F.col("_c.text")).otherwise(text).alias("text"),
                          F.size(_lines(text)).cast("long").alias("n_lines"), F.col("_c.n_removed").alias("n_removed"))
