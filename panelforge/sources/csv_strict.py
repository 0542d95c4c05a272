"""Strict, all-text CSV scan with file and header checks.

* Every column is read as STRING from an explicit schema; nothing is inferred,
  so commas, blanks and leading zeros reach the contract checks untouched.
* The UTF-8 BOM is stripped by Spark's CSV reader.
* The header of every file is read as data and compared with the spec in
  order by the contract, so a reordered header fails instead of being
  silently re-mapped by name.
* Short and long records are kept: PERMISSIVE mode fills / drops cells and
  sets ``_corrupt_record``, which we turn into ``_width_ok = false``.
* ``_ord`` is an ingestion ordinal (monotonic in file order) used only for
  the file-order diagnostic; ``_file`` names the source file.
"""

from __future__ import annotations

import csv
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def text_schema(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType(), True) for c in columns])


@dataclass
class StrictScan:
    path: str
    exists: bool
    header: list[str]
    rows: DataFrame | None   # spec columns (text) + _width_ok + _ord + _file


def path_exists(spark: SparkSession, path: str) -> bool:
    """A missing file is a failed check, not an exception."""
    try:
        spark.read.text(path).limit(0).collect()
        return True
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return False
        raise


def read_headers(spark: SparkSession, path: str) -> list[list[str]]:
    """Two different first records of the files at most, parsed with CSV rules (quotes, BOM): one, if all agree."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("i")).where("at = 0")
    first = lines.groupBy("file").agg(F.min_by("value", "i").alias("line")).select("line").distinct()
    return [next(csv.reader([r.line.removeprefix("\ufeff")]), []) for r in first.limit(2).collect()]


def read_header(spark: SparkSession, path: str, columns=()) -> list[str]:
    """The header of the files; where they differ, one that is not ``columns``, so that the contract fails."""
    headers = read_headers(spark, path)
    return next((h for h in headers if h != list(columns)), headers[0] if headers else [])


def read_text_csv(spark: SparkSession, path, columns) -> DataFrame:
    """All-string scan of one or more files with the spec's column names."""
    schema = text_schema(columns).add(T.StructField(CORRUPT, T.StringType(), True))
    return (
        spark.read.schema(schema)
        .option("header", "true")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("encoding", "UTF-8")
        .csv(path)
    )


def with_scan_columns(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("_width_ok", F.col(CORRUPT).isNull())
        .withColumn("_ord", F.monotonically_increasing_id())
        .withColumn("_file", F.input_file_name())
        .drop(CORRUPT)
    )


def strict_csv(spark: SparkSession, path: str, columns) -> StrictScan:
    if not path_exists(spark, path):
        return StrictScan(path, False, [], None)
    header = read_header(spark, path, columns)
    rows = with_scan_columns(read_text_csv(spark, path, columns))
    return StrictScan(path, True, header, rows)
