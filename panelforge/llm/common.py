"""Helpers that several operators share: row keys, word splitting, shared storage."""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, tune
from ..sources.fs import delete

#: Characters that separate words: space and 0x09-0x0D.
WORD_SPACE = " \t\n\x0b\x0c\r"


#: Whether the shuffle files of a query go when it has ended.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the folder that ``spark.checkpoint.dir`` names.

    Cuts the lineage and gives Catalyst the true size of the table; every
    executor can read the files, so a lost executor costs nothing but a retry.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes the files of tables that :func:`written` made and that nothing reads any more."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            delete(table.sparkSession, folder)


def freed(operator):
    """``operator(df, ...)``, whose own jobs leave no shuffle files behind; the session's setting is put back."""

    @functools.wraps(operator)
    def run(df: DataFrame, *args, **kwargs):
        conf, before = df.sparkSession.conf, df.sparkSession.conf.get(FREE_SHUFFLES)
        conf.set(FREE_SHUFFLES, "true")
        try:
            return operator(df, *args, **kwargs)
        finally:
            conf.set(FREE_SHUFFLES, before)

    return run


def row_key(*cols: Column | str) -> list[Column]:
    """Two 64-bit hashes of the given columns, ``_k1`` and ``_k2``; never null.

    Rows equal in these columns are the same row to an operator and get the
    same decision; ids that are null or repeat do not mix up different rows.
    """
    flat = [x for c in cols for x in (F.col(c) if isinstance(c, str) else c,)]
    marked = [y for x in flat for y in (x, x.isNull())]
    return [F.xxhash64(*marked).alias("_k1"), F.xxhash64(F.lit("second"), *marked).alias("_k2")]


def words_of(text: Column) -> Column:
    """Array of the maximal runs without :data:`WORD_SPACE`; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once (a lambda variable is a slot, not an expression)."""
    return F.transform(F.array(value), body)[0]


def arrow_rows(batches: Iterator[pa.RecordBatch], build, schema: pa.Schema, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Applies ``build(columns as lists) -> columns as lists`` to slices of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            out = build(*[c.to_pylist() for c in part.columns])
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema, strict=True)], schema=schema)


def ready(spark: SparkSession) -> SparkSession:
    """The session with the package's runtime settings, and its Python workers with this package on their path."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)
    return tune(spark)
