"""Registered queries that write tables, change them and read them back.

Each call writes into a folder of its own under ``spark.checkpoint.dir``, which the
result is read from, so the folder stays until whoever owns that directory clears it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import ym_text
from ..operators import hashtree as H
from ..operators import incremental as I
from ..operators.warehouse import load_star, read_fact, staging_path
from . import panel as P
from .queries import S, register

NATION_KEY = ["n_name", "year_month", "tech_code"]


def _nation_fact(panel: DataFrame) -> DataFrame:
    return panel.select("n_name", F.col("ym").alias("year_month"), "tech_code", "accounts", F.year("ym").alias("year"))


def _batches(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The legacy state (orders that have lines), and the live one, which revises twenty months and adds the rest."""
    legacy = P.nation_panel(spark, sf_dir, P.orders_with_lines(spark, sf_dir, "o_orderdate", "o_orderpriority", "o_custkey"))
    live = P.nation_panel(spark, sf_dir, P.read_table(spark, sf_dir, "orders", "o_custkey", "o_orderdate", "o_orderpriority"))
    return [_nation_fact(legacy.where(F.col("ym") <= F.lit(P.LEGACY_TO))), _nation_fact(live.where(F.col("ym") >= F.lit(P.LIVE_FROM)))]


@register("rollup_incremental")
def rollup_incremental(spark, sf_dir):
    """Accounts by nation and year after two merged batches, kept by their signed changes alone."""
    root = staging_path(spark, "rollup-query")
    rollup = I.Rollup(os.path.join(root, "rollup"), ("n_name", "year"), ("accounts",), "year")
    for seq, batch in enumerate(_batches(spark, sf_dir), 1):
        I.merge_and_maintain(spark, os.path.join(root, "fact"), batch, NATION_KEY, "year", [rollup], seq)
    kept = I.read_rollup(spark, rollup)
    avg = F.round(F.col("accounts").cast("decimal(38,0)") / F.col("n"), 0).cast("bigint")
    return kept.select("n_name", "year", F.col("n").alias("n_rows"), F.col("accounts").alias("total"), avg.alias("avg_accounts"))


@register("metrics_incremental")
def metrics_incremental(spark, sf_dir):
    """M7 R2: the metric table by nation after two merged batches; the second recomputes from its first changed month on."""
    root = staging_path(spark, "metrics-query")
    fact, kept = os.path.join(root, "fact"), os.path.join(root, "metrics")
    for seq, batch in enumerate(_batches(spark, sf_dir), 1):
        changes = I.merge_and_maintain(spark, fact, batch, NATION_KEY, "year", [], seq)
        I.maintain_metrics(spark, kept, spark.read.schema(batch.schema).parquet(fact), changes, S, ["n_name"], partition_by="year")
    return spark.read.parquet(kept).drop("year").withColumn("ym", ym_text(F.col("ym")))


@register("warehouse_load")
def warehouse_load(spark, sf_dir):
    """Two loads of the star schema, the second upserting the first, read back with both dimensions."""
    root = staging_path(spark, "load-query")
    panel = P.orders_panel(spark, sf_dir)
    for source in (P.legacy_source(panel), P.live_source(panel)):
        load_star(spark, root, source, S)
    tech = spark.read.parquet(os.path.join(root, "dim_technology")).select("tech_code", "camp")
    period = spark.read.parquet(os.path.join(root, "dim_period")).select("year_month", "quarter", "roc_year")
    fact = read_fact(spark, root).join(tech, "tech_code").join(period, "year_month")
    return fact.select(ym_text(F.col("year_month")).alias("year_month"), "tech_code", "accounts", "source", "camp", "quarter", "roc_year")


LINE_STATE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "quantity", "l_returnflag", "l_linestatus", "day"]
REVISED_FROM, REVISED_TO, CUT = "1997-05-01", "1997-05-31", "2001-10-01"


def _line_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All lines by ship day; and a state with one month's returns revised and the last days missing."""
    li = P.read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                      "l_returnflag", "l_linestatus", "l_shipdate")
    a = li.withColumn("quantity", F.col("l_quantity").cast("bigint")).withColumn("day", F.unix_date(F.col("l_shipdate").cast("date")))
    shipped = F.col("l_shipdate").cast("date")
    revised = shipped.between(F.lit(REVISED_FROM).cast("date"), F.lit(REVISED_TO).cast("date")) & (F.col("l_returnflag") == "R")
    b = a.where(shipped < F.lit(CUT).cast("date")).withColumn("quantity", F.when(revised, F.col("quantity") + 1).otherwise(F.col("quantity")))
    return a.select(*LINE_STATE), b.select(*LINE_STATE)


@register("state_diff_tree")
def state_diff_tree(spark, sf_dir):
    """Rows that two states of lineitem hold in different numbers; only days whose digests differ are compared by row."""
    a, b = _line_states(spark, sf_dir)
    return H.state_diff(a, b, "day", 1, LINE_STATE)
