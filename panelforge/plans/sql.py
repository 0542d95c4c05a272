"""SQL access to the star schema: its tables and the operators' results as temp views.

``register_star`` exposes the three star tables (and, if present, the scale
table). The functions run the DataFrame operators on them and register each
result as a view, so that SQL users query the same numbers.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import spec as S
from ..functions.periods import ym_text
from ..operators import metrics as M
from ..operators import warehouse as W
from ..sources.fs import exists

STAR = ("fact_subscriptions_monthly", "dim_technology", "dim_period")


def register_star(spark: SparkSession, warehouse: str, extra=("bench_subscriptions",)) -> None:
    for name in (*STAR, *extra):
        p = os.path.join(warehouse, name)
        if exists(spark, p):
            spark.read.parquet(p).createOrReplaceTempView(name)


def _view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def _fact(spark: SparkSession) -> DataFrame:
    return spark.table("fact_subscriptions_monthly")


def metrics(spark: SparkSession, spec=S.BROADBAND) -> DataFrame:
    panel = _fact(spark).select(F.col("year_month").alias("ym"), "tech_code", "accounts")
    return _view(M.panel_metrics(M.group_levels(panel, spec), spec).orderBy("ym"), "panel_metrics")


def snapshot(spark: SparkSession) -> DataFrame:
    return _view(W.snapshot(_fact(spark)), "fact_snapshot")


def _months() -> list:
    return [ym_text(F.min("year_month")).alias("first_ym"), ym_text(F.max("year_month")).alias("last_ym")]


def report_by_camp(spark: SparkSession) -> DataFrame:
    camps = _fact(spark).join(spark.table("dim_technology"), "tech_code").groupBy("camp").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("tech_code").alias("techs"), *_months())
    return _view(camps.orderBy("camp"), "report_by_camp")


def report_by_source(spark: SparkSession) -> DataFrame:
    sources = _fact(spark).groupBy("source").agg(F.count(F.lit(1)).alias("rows"), *_months())
    return _view(sources.orderBy("source"), "report_by_source")


def bad_rows(spark: SparkSession) -> DataFrame:
    return _view(W.bad_rows(_fact(spark)), "fact_bad_rows")
