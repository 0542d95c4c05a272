"""S3: table scans of the driver's Parquet tables and of our own star schema.

Scans are plain ``spark.read.parquet``; callers select only the columns they
need so Catalyst prunes the ``ReadSchema`` and pushes filters to the scan.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from .fs import exists

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Scan of a driver table, listed anew for each call, so that new files are never missed."""
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*cols) if cols else df


def register_views(spark: SparkSession, sf_dir: str, names=DRIVER_TABLES) -> None:
    """Expose the driver tables as temp views (for SQL users)."""
    for n in names:
        p = table_path(sf_dir, n)
        if exists(spark, p):
            spark.read.parquet(p).createOrReplaceTempView(n)
