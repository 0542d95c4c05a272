"""Small literal tables (spec lists) built inside the JVM.

``spark.createDataFrame(list)`` in classic PySpark ships the rows through a
Python RDD, whose size Catalyst cannot see. ``literal_table`` builds the same
rows as ``inline(array(struct(...)))`` over a one-row range, which the
optimizer folds to a local relation with known statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal_table(spark: SparkSession, rows, schema: str) -> DataFrame:
    """``schema`` is DDL (``"a string, b date"``); values must match it."""
    fields = [f.strip().split(None, 1) for f in schema.split(",")]
    names = [n for n, _ in fields]
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(t).alias(n) for n, t in fields])
    structs = [F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, fields)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs))).select(*names)
