"""G5, R6, S7, M7 kept up to date: a merge's changes carried into what is derived from the fact.

A merge yields its changes as signed rows: a new row counts +1, a revised one -1
as it was and +1 as it is. Counts and sums of a rollup are linear in them, so it
is brought up to date by adding the summed changes of each group; averages
follow from both. Only partitions that hold such a group are read and written.
The metric table follows by its windows from the first changed month on.

A batch has a sequence number. Its changes are written down before anything is
merged, and every partition of a rollup keeps the number of the batch it has
seen last. A run that was lost half-way is run again with the same number: it
takes the changes as written, merges the same rows and adds them where they are
missing. A batch older than the last one is not merged again.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..sources.fs import delete, exists, names
from ..spec import PanelSpec
from .metrics import group_levels, metrics_tail, panel_metrics
from .warehouse import batch_partitions, replace_partitions, upsert


@dataclass(frozen=True)
class Rollup:
    """A stored table of ``by``, the number of fact rows ``n``, and the sums of ``measures`` (whole numbers).

    It is partitioned by ``partition_by``, one of ``by``.
    """

    path: str
    by: tuple[str, ...]
    measures: tuple[str, ...]
    partition_by: str


def signed_changes(old: DataFrame, batch: DataFrame, keys, policy: str = "update", compare=None) -> DataFrame:
    """What merging ``batch`` into ``old`` changes: the columns of ``batch`` and ``sign``, +1 for a row that comes and
    -1 for one that goes. ``compare`` names the columns that make a row another (default: all)."""
    cols = batch.columns
    if policy not in ("update", "ignore"):
        raise ValueError(f"unknown merge policy {policy!r}")
    was = old.select(*keys, F.struct(*cols).alias("__old"))
    both = batch.select(*keys, F.struct(*cols).alias("__new")).join(was, list(keys), "left")
    come, go = (F.struct(F.col(c).alias("row"), F.lit(sign).alias("sign")) for c, sign in (("__new", 1), ("__old", -1)))
    made = F.when(F.col("__old").isNull(), F.array(come))
    if policy == "update":
        same = F.lit(True)
        for c in compare or cols:
            same = same & F.col("__new")[c].eqNullSafe(F.col("__old")[c])
        made = made.when(~same, F.array(go, come))
    return both.select(F.explode(made).alias("x")).select("x.row.*", "x.sign")


def rollup_delta(changes: DataFrame, rollup: Rollup) -> DataFrame:
    """The signed sums of each group: ``by, n, measures``; groups without a difference are left out."""
    sums = [F.sum(F.col("sign") * F.coalesce(F.col(m), F.lit(0))).cast("bigint").alias(m) for m in rollup.measures]
    delta = changes.groupBy(*rollup.by).agg(F.sum("sign").cast("bigint").alias("n"), *sums)
    moved = F.col("n") != 0
    for m in rollup.measures:
        moved = moved | (F.col(m) != 0)
    return delta.where(moved)


def _stored(spark: SparkSession, rollup: Rollup, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(rollup.path)


def touched_groups(spark: SparkSession, rollup: Rollup, schema, values: list) -> DataFrame:
    """The stored rows of the partitions ``values``; no others are listed or read."""
    return _stored(spark, rollup, schema).where(F.col(rollup.partition_by).isin(values))


def apply_delta(spark: SparkSession, rollup: Rollup, delta: DataFrame, seq: int) -> list:
    """Adds ``delta`` (of batch ``seq``) to the stored rollup; returns the partitions written.

    A partition that has seen this batch or a later one is left as it is. A group without rows stays with ``n = 0``,
    so that its partition still tells what it has seen; :func:`read_rollup` leaves it out.
    """
    part = rollup.partition_by
    new = delta.withColumn("as_of", F.lit(seq).cast("bigint"))
    touched = [r[0] for r in delta.select(part).distinct().collect()]
    if not touched:
        return []
    if exists(spark, rollup.path):
        near = touched_groups(spark, rollup, new.schema, touched)
        seen = {r[0] for r in near.groupBy(part).agg(F.max("as_of").alias("at")).where(F.col("at") >= seq).collect()}
        touched = [v for v in touched if v not in seen]
        if not touched:
            return []
        near = touched_groups(spark, rollup, new.schema, touched)
        new = near.unionByName(new.where(F.col(part).isin(touched))).groupBy(*rollup.by).agg(
            *[F.sum(c).cast("bigint").alias(c) for c in ("n", *rollup.measures)], F.lit(seq).cast("bigint").alias("as_of"))
    whole = F.when(F.col("n") >= 0, F.col("n")).otherwise(F.raise_error(F.lit("more rows leave a group than it has")).cast("bigint"))
    replace_partitions(spark, rollup.path, new.withColumn("n", whole), part)
    return touched


def read_rollup(spark: SparkSession, rollup: Rollup) -> DataFrame:
    return spark.read.parquet(rollup.path).where("n > 0").drop("as_of")


def merge_and_maintain(spark: SparkSession, path: str, batch: DataFrame, keys, partition_by: str, rollups, seq: int,
                       policy: str = "update", compare=None) -> DataFrame:
    """S7 with its rollups: merges ``batch`` number ``seq`` into the fact at ``path``; returns its signed changes.

    The partition must be a function of the key, so that a batch's keys lie in its own partitions and no others are
    read. Changes are kept beside the fact until the next batch.
    """
    log = f"{path.rstrip('/')}_changes"
    known = [int(x.removeprefix("seq=")) for x in names(spark, log) if x.startswith("seq=")]
    at = os.path.join(log, f"seq={seq}")
    schema = StructType([*batch.schema.fields, StructField("sign", IntegerType())])
    if known and seq < max(known):
        return spark.createDataFrame([], schema)
    if not exists(spark, os.path.join(at, "_SUCCESS")):
        touched = batch_partitions(batch, keys, partition_by)
        if exists(spark, path):
            old = spark.read.schema(batch.schema).parquet(path).where(F.col(partition_by).isin(touched))
        else:
            old = batch.limit(0)
        signed_changes(old, batch, keys, policy, compare).write.mode("overwrite").parquet(at)
    changes = spark.read.schema(schema).parquet(at)
    upsert(spark, path, changes.where("sign = 1").drop("sign"), keys, partition_by, check_unique=False, moves=False)
    for rollup in rollups:
        apply_delta(spark, rollup, rollup_delta(changes, rollup), seq)
    for old_seq in known:
        if old_seq < seq:
            delete(spark, os.path.join(log, f"seq={old_seq}"))
    return changes


def changed_levels(fact: DataFrame, changes: DataFrame, spec: PanelSpec, dims=(), ym: str = "year_month",
                   partition_by: str | None = None) -> DataFrame:
    """Levels of the months that ``changes`` names, from the merged ``fact``; of it only their partitions are read."""
    months = changes.select(*dims, ym).distinct()
    if partition_by:
        values = [r[0] for r in changes.select(partition_by).distinct().collect()]
        fact = fact.where(F.col(partition_by).isin(values))
    return group_levels(fact.join(months, [*dims, ym], "left_semi").withColumnRenamed(ym, "ym"), spec, dims)


def maintain_metrics(spark: SparkSession, path: str, fact: DataFrame, changes: DataFrame, spec: PanelSpec, dims=(),
                     ym: str = "year_month", partition_by: str | None = None) -> None:
    """M7 as a stored table ``year=.../`` that follows the fact: rows from the first changed month on are replaced.

    Running it again with the same changes writes the same rows.
    """
    if exists(spark, path):
        stored = spark.read.parquet(path).drop("year")
        new = metrics_tail(stored, changed_levels(fact, changes, spec, dims, ym, partition_by), spec, dims)
    else:
        new = panel_metrics(group_levels(fact.withColumnRenamed(ym, "ym"), spec, dims), spec, dims, ym_as_text=False)
    upsert(spark, path, new.withColumn("year", F.year("ym")), [*dims, "ym"], "year", check_unique=False, moves=False)
