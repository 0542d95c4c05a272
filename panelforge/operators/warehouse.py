"""S4-S8, R4, C9-C12 on the star schema: dims, fact, idempotent merge, snapshot.

Storage is partitioned Parquet (no table format is assumed). The fact
``fact_subscriptions_monthly(year_month, tech_code, accounts, source,
loaded_at)`` is partitioned by ``year`` (or by month, see R7) and keyed by
``(year_month, tech_code)``.

Merge protocol (``upsert``):
1-2. In one job: reject a batch that repeats a key (the database would refuse
   to touch a row twice in one statement) or has a null key, and collect the batch's partition
   values — bounded by the number of partitions it touches, never by rows.
3. Read only those partitions of the target (partition pruning) and those
   where the batch's keys lay before, merge with
   the batch by anti join + union (policy ``update``: batch wins and gets a
   fresh ``loaded_at``; policy ``ignore``: existing rows win). Rows absent
   from the batch stay: the merge never deletes.
4. Write the merged partitions to a staging folder under the session's
   ``spark.checkpoint.dir`` (a shared path on a cluster), which cuts the
   lineage, then overwrite the touched partitions of the target from the
   staging copy with dynamic partition overwrite. Untouched partitions are
   never rewritten. Re-running the same batch yields the same table, so a
   retried or replayed batch is harmless.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import ad_to_roc, ym_text
from ..session import checkpoint_dir
from ..sources.fs import delete, exists
from ..spec import PanelSpec
from ..sources.literal import literal_table

FACT_KEY = ["year_month", "tech_code"]
FACT_COLS = ["year_month", "tech_code", "accounts", "source"]


class DuplicateBatchKeys(ValueError):
    pass


class NullBatchKeys(ValueError):
    pass


class BadRecords(ValueError):
    pass


def dim_technology(spark: SparkSession, spec: PanelSpec) -> DataFrame:
    rows = [(c, spec.names.get(c, c), g) for c, g in sorted(spec.groups.items())]
    return literal_table(spark, rows, "tech_code string, tech_name string, camp string")


def dim_period(records: DataFrame) -> DataFrame:
    """One row per month present in the records."""
    m = records.select(F.col("ym").alias("year_month")).where(F.col("year_month").isNotNull()).distinct()
    return m.select(
        "year_month",
        F.year("year_month").alias("year"),
        F.month("year_month").alias("month"),
        ad_to_roc(F.year("year_month")).alias("roc_year"),
        F.quarter("year_month").alias("quarter"),
    )


def fact_rows(records: DataFrame) -> DataFrame:
    """Fact rows from long records, stamped with the load time."""
    return records.select(
        F.col("ym").alias("year_month"), "tech_code", F.col("accounts").cast("bigint").alias("accounts"),
        "source", F.current_timestamp().alias("loaded_at"))


def merge_frames(old: DataFrame, batch: DataFrame, keys, policy: str = "update") -> DataFrame:
    """S5/S6/S7 as a pure DataFrame: anti join + union, never deleting.

    ``update``: keys in the batch take the batch row; ``ignore``: keys already
    present keep the old row and only new keys are added.
    """
    cols = old.columns
    if policy == "update":
        keep = old.join(batch.select(*keys), list(keys), "left_anti")
        return keep.unionByName(batch.select(*cols))
    if policy == "ignore":
        new = batch.join(old.select(*keys), list(keys), "left_anti")
        return old.unionByName(new.select(*cols))
    raise ValueError(f"unknown merge policy {policy!r}")


def staging_path(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), f"staging-{name}-{uuid.uuid4().hex}")


def batch_partitions(batch: DataFrame, keys, partition_by: str, check_unique: bool = True) -> list:
    """One job: the partition values a batch touches. Null keys or partition values are refused, and (optionally)
    keys that repeat — per key counts, folded per partition value."""
    null = F.lit(False)
    for c in (*keys, partition_by):
        null = null | F.col(c).isNull()
    rows = batch.withColumn("__null", null.cast("int"))
    if check_unique:
        rows = rows.groupBy(*keys, partition_by).agg(F.count(F.lit(1)).alias("__n"), F.max("__null").alias("__null"))
        rows = rows.groupBy(partition_by).agg(F.max("__n").alias("__max"), F.max("__null").alias("__null")).collect()
    else:
        rows = rows.groupBy(partition_by).agg(F.lit(1).alias("__max"), F.max("__null").alias("__null")).collect()
    if any(r["__null"] for r in rows):
        raise NullBatchKeys(f"batch has null in {[*keys, partition_by]}")
    dup = [r[partition_by] for r in rows if r["__max"] > 1]
    if dup:
        raise DuplicateBatchKeys(f"batch repeats keys in partition(s) {dup[:5]}")
    return [r[partition_by] for r in rows]


def _moved(old: DataFrame, batch: DataFrame, keys, partition_by: str) -> dict:
    """Partitions (value: folder) that hold a key of the batch which the batch has under another value."""
    here = old.select(*keys, F.col(partition_by).alias("__was"), F.input_file_name().alias("__file"))
    both = here.join(batch.select(*keys, partition_by), list(keys)).where(F.col("__was") != F.col(partition_by))
    folder = F.regexp_replace("__file", "/[^/]*$", "")
    return {r[0]: r[1] for r in both.groupBy("__was").agg(F.min(folder)).collect()}


def replace_partitions(spark: SparkSession, path: str, rows: DataFrame, partition_by: str, after=None) -> None:
    """Overwrites the partitions that ``rows`` has (it may read them) by way of a staging folder; the others stay.

    ``after`` is called with the staged rows before the folder goes."""
    stage = staging_path(spark, os.path.basename(path.rstrip("/")))
    try:
        rows.write.mode("overwrite").parquet(stage)
        staged = spark.read.schema(rows.schema).parquet(stage)
        # rows of one partition together, and a partition that is too large for one task over several
        (staged.hint("rebalance", partition_by).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path))
        if after:
            after(staged)
    finally:
        delete(spark, stage)


def upsert(spark: SparkSession, path: str, batch: DataFrame, keys, partition_by: str,
           policy: str = "update", check_unique: bool = True, moves: bool = True) -> list:
    """Merge ``batch`` into the Parquet table at ``path``; returns touched partitions.

    ``check_unique=False`` only for batches unique by construction (a
    ``distinct`` or a spec's literal list); ``moves=False`` only where the
    partition is a function of the key, else a key may come back under another
    partition value and its old row is looked up over the whole table."""
    touched = batch_partitions(batch, keys, partition_by, check_unique)
    if not touched:
        return []
    if not exists(spark, path):
        batch.hint("rebalance", partition_by).write.mode("overwrite").partitionBy(partition_by).parquet(path)
        return touched
    # The batch's own types: Spark would infer a partition '01' as 1.
    old = spark.read.schema(batch.schema).parquet(path)
    gone = _moved(old, batch, keys, partition_by) if moves else {}
    all_parts = [*touched, *(v for v in gone if v not in touched)]
    near = old.filter(F.col(partition_by).isin(all_parts))
    merged = merge_frames(near.select(*batch.columns), batch, keys, policy)

    def drop_left(staged: DataFrame) -> None:
        left = {r[0] for r in staged.where(F.col(partition_by).isin([*gone])).select(partition_by).distinct().collect()}
        for value, folder in gone.items():
            if value not in left:  # every row of it moved away; an overwrite leaves such a folder as it was
                delete(spark, folder)

    replace_partitions(spark, path, merged, partition_by, drop_left if gone else None)
    return all_parts


def check_fact(records: DataFrame, spec: PanelSpec) -> None:
    """C9-C12 on records about to be loaded: nothing null, negative, of an unknown code or with a key twice."""
    rows = records.select("ym", "tech_code", F.col("accounts").cast("bigint").alias("accounts"), "source")
    bad = F.col("ym").isNull() | F.col("tech_code").isNull() | F.col("accounts").isNull() | F.col("source").isNull() | (
        F.col("accounts") < 0) | ~F.col("tech_code").isin(*spec.groups)
    n = rows.agg(F.sum(F.coalesce(bad, F.lit(True)).cast("bigint")).alias("n")).first()["n"]
    if n:
        raise BadRecords(f"{n} records break NOT NULL, CHECK or a foreign key")


def load_star(spark: SparkSession, warehouse: str, records: DataFrame, spec: PanelSpec,
              partition: str = "year") -> dict:
    """Write / merge the three star tables from validated records."""
    check_fact(records, spec)
    # both dims are unique by construction (spec dict keys; distinct months)
    tech = dim_technology(spark, spec).withColumn("_p", F.lit(0))
    upsert(spark, os.path.join(warehouse, "dim_technology"), tech, ["tech_code"], "_p", "update", False, moves=False)
    per = dim_period(records).withColumn("_p", F.lit(0))
    upsert(spark, os.path.join(warehouse, "dim_period"), per, ["year_month"], "_p", "ignore", False, moves=False)
    fact = fact_rows(records)
    part_col = F.year("year_month") if partition == "year" else ym_text(F.col("year_month"))
    fact = fact.withColumn(partition, part_col)
    touched = upsert(spark, os.path.join(warehouse, "fact_subscriptions_monthly"), fact, FACT_KEY,
                     partition, "update", moves=False)
    return {"touched": sorted(touched)}


def read_fact(spark: SparkSession, warehouse: str) -> DataFrame:
    return spark.read.parquet(os.path.join(warehouse, "fact_subscriptions_monthly"))


def snapshot(fact: DataFrame, ordered: bool = True) -> DataFrame:
    """Count, sum, first / last month, distinct codes, fingerprint.

    One shuffle by month: each month yields its row count, sum, code set
    (bounded by the code domain) and ordered md5; a final one-row aggregate
    folds the months. ``loaded_at`` is excluded (T14).

    ``ordered=False`` is for facts with extra dimensions, where one month is no
    longer bounded by the code list: the fingerprint is then the unordered
    ``xxhash64`` sum (partial aggregation only, no per-row strings) and the
    code count a plain ``count(distinct)``.
    """
    if not ordered:
        from .fingerprint import unordered_fingerprint
        from .splice import one_row
        stats = fact.agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.coalesce(F.sum("accounts"), F.lit(0)).cast("bigint").alias("sum_accounts"),
            ym_text(F.min("year_month")).alias("min_ym"), ym_text(F.max("year_month")).alias("max_ym"),
            F.count_distinct("tech_code").alias("n_tech"))
        fp = unordered_fingerprint(fact, FACT_COLS, "xxhash64").select(F.col("hash_sum").alias("md5"))
        return one_row(stats, fp)
    return fold_months(month_states(fact))


def month_states(fact: DataFrame) -> DataFrame:
    """``year_month, n, s, h, codes`` of each month: rows, sum, ordered md5 of its rows, set of codes."""
    from ..functions.rowcode import row_text
    enc = fact.select("year_month", "tech_code", "accounts",
                      row_text(fact, FACT_COLS).alias("__t"))
    return enc.groupBy("year_month").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("accounts").alias("s"),
        F.expr("md5(listagg(__t, '\\n') WITHIN GROUP (ORDER BY tech_code))").alias("h"),
        F.collect_set("tech_code").alias("codes"),
    )


def fold_months(states: DataFrame) -> DataFrame:
    """The one-row snapshot of a fact from its :func:`month_states`."""
    # a key never repeats, so a month's set of codes is no longer than the code list
    all_codes = F.aggregate(F.collect_set("codes"), F.array().cast("array<string>"), F.array_union)
    return states.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_rows"),
        F.coalesce(F.sum("s"), F.lit(0)).cast("bigint").alias("sum_accounts"),
        ym_text(F.min("year_month")).alias("min_ym"),
        ym_text(F.max("year_month")).alias("max_ym"),
        F.size(all_codes).cast("bigint").alias("n_tech"),
        F.expr("md5(listagg(h, '\\n') WITHIN GROUP (ORDER BY year_month))").alias("md5"),
    )


def bad_rows(fact: DataFrame) -> DataFrame:
    """Rows violating NOT NULL / CHECK on the fact."""
    null = F.lit(False)
    for c in (*FACT_COLS, "loaded_at"):
        null = null | F.col(c).isNull()
    return fact.filter(null | (F.col("accounts") < 0)).agg(
        F.count(F.lit(1)).alias("n_bad"))


def verify_idempotent(spark: SparkSession, warehouse: str, records: DataFrame, spec: PanelSpec,
                      partition: str = "year") -> dict:
    """Load, snapshot, load the same input again, snapshot; all must agree."""
    load_star(spark, warehouse, records, spec, partition)
    first = snapshot(read_fact(spark, warehouse)).first().asDict()
    load_star(spark, warehouse, records, spec, partition)
    fact = read_fact(spark, warehouse)
    second = snapshot(fact).first().asDict()
    nbad = bad_rows(fact).first()["n_bad"]
    return {"identical": first == second, "bad_rows": int(nbad), "first": first, "second": second}
