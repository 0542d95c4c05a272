"""The driver-table panel: ``orders`` re-read as a monthly category panel.

The original raw files are not available, so every registered query runs on
the driver's tables, mapped as follows (fixed before looking at results):

* ``ym = trunc(o_orderdate, 'MM')``, ``tech_code = o_orderpriority`` (5 codes)
* ``accounts = count(*)``; ``cents = sum(round(o_totalprice * 100))`` as an
  exact decimal, large enough to carry thousands separators
* groups ``1-URGENT, 2-HIGH → A``; ``3-MEDIUM → B``; the rest ``EXCLUDED``
* two sources over the same facts: ``live`` from 1997-01, ``legacy`` up to
  1998-08, cutover 1997-01 → 20 overlap months
* extra dimension ``r_name`` via customer → nation → region

Aggregation to (month, code[, dims]) happens first with a partial aggregate on
the map side, so the shuffle carries one row per key per task, whatever the
size of ``orders``. Hot codes or months cost nothing extra: partial sums
collapse them before the exchange.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parse import thousands
from ..functions.periods import month_of
from ..sources.tables import read_table
from ..spec import ROC_OFFSET, PanelSpec, SourceSpec, SumSpec

# Fixed values for the driver-table mapping --------------------------------
ORDER_GROUPS = {
    "1-URGENT": "A",
    "2-HIGH": "A",
    "3-MEDIUM": "B",
    "4-NOT SPECIFIED": "EXCLUDED",
    "5-LOW": "EXCLUDED",
}
ORDER_CODES = sorted(ORDER_GROUPS)
ORDER_COMPARABLE = ("1-URGENT", "2-HIGH", "3-MEDIUM")
LIVE_FROM = dt.date(1997, 1, 1)
LEGACY_TO = dt.date(1998, 8, 1)
CUTOVER = dt.date(1997, 1, 1)
SRC_LIVE = "live"
SRC_LEGACY = "legacy"
BREAK_MONTHS = ("1997-01", "2000-01")
ANCHOR_YM = "1997-01"
ANNOTATIONS = [
    (dt.date(1996, 5, 1), "1996-05 event", "annotation"),
    (dt.date(1999, 3, 18), "1999-03-18 event", "annotation"),
]

ORDERS_SPEC = PanelSpec(
    groups=ORDER_GROUPS, primary="A", secondary="B", comparable=ORDER_COMPARABLE,
    cutover=CUTOVER,
)


def cents(price_col: str) -> F.Column:
    """Money as exact integer cents: the value rounded half-up to 2 decimals.

    DECIMAL(14,2) × 100 stays within 18 digits, so Spark keeps it as a 64-bit
    compact decimal (no BigDecimal per row).
    """
    return (F.col(price_col).cast("decimal(14,2)") * 100).cast("bigint")


def line_amount_cents() -> F.Column:
    """round(extendedprice × (1 + tax) × (1 − discount), 2) in cents, half-up.

    Exact integer arithmetic: cents × (100 + tax%) × (100 − discount%) is the
    amount in 1/10000 cents, then divided with half-up rounding. Equal by
    construction to the same product in decimals, without 30-digit decimals.
    """
    x = ("CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * 100 AS BIGINT)"
         " * (100 + CAST(CAST(l_tax AS DECIMAL(4,2)) * 100 AS INT))"
         " * (100 - CAST(CAST(l_discount AS DECIMAL(4,2)) * 100 AS INT))")
    return F.expr(f"CASE WHEN {x} >= 0 THEN ({x} + 5000) div 10000 ELSE -((5000 - {x}) div 10000) END")


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long panel ``(ym, tech_code, accounts, cents)`` from ``orders``."""
    o = read_table(spark, sf_dir, "orders", "o_orderdate", "o_orderpriority", "o_totalprice")
    return o.groupBy(
        month_of(F.col("o_orderdate")).alias("ym"),
        F.col("o_orderpriority").alias("tech_code"),
    ).agg(
        F.count(F.lit(1)).alias("accounts"),
        F.sum(cents("o_totalprice")).cast("bigint").alias("cents"),
    )


def orders_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with ``r_name``: orders ⋈ customer (shuffle join on custkey) ⋈
    nation ⋈ region (25 and 5 rows, auto-broadcast by their measured size)."""
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate",
                   "o_orderpriority", "o_totalprice")
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey")
    r = read_table(spark, sf_dir, "region", "r_regionkey", "r_name")
    geo = (c.join(n, c.c_nationkey == n.n_nationkey)
           .join(r, n.n_regionkey == r.r_regionkey)
           .select("c_custkey", "r_name"))
    return o.join(geo, o.o_custkey == geo.c_custkey).drop("c_custkey")


def orders_panel_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders_region(spark, sf_dir)
    return o.groupBy(
        "r_name",
        month_of(F.col("o_orderdate")).alias("ym"),
        F.col("o_orderpriority").alias("tech_code"),
    ).agg(F.count(F.lit(1)).alias("accounts"))


def orders_with_lines(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    """Orders that have a line: a second account of the same facts, which differs where lines are missing.

    The lines' keys are made distinct before the shuffle, so an order with many lines is one row of the join.
    """
    lines = read_table(spark, sf_dir, "lineitem", "l_orderkey").distinct()
    o = read_table(spark, sf_dir, "orders", "o_orderkey", *cols)
    return o.join(lines, o.o_orderkey == lines.l_orderkey, "left_semi")


def lines_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long panel ``(ym, tech_code, accounts)`` of the orders that have a line."""
    o = orders_with_lines(spark, sf_dir, "o_orderdate", "o_orderpriority")
    return o.groupBy(month_of(F.col("o_orderdate")).alias("ym"), F.col("o_orderpriority").alias("tech_code")).agg(
        F.count(F.lit(1)).alias("accounts"))


def nation_panel(spark: SparkSession, sf_dir: str, orders: DataFrame) -> DataFrame:
    """Long panel by nation: so fine that months and codes are missing. Orders are counted by customer before the join."""
    month, code = month_of(F.col("o_orderdate")).alias("ym"), F.col("o_orderpriority").alias("tech_code")
    o = orders.groupBy("o_custkey", month, code).agg(F.count(F.lit(1)).alias("n"))
    c = read_table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    n = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    geo = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", "n_name")
    return o.join(geo, o.o_custkey == geo.c_custkey).groupBy("n_name", "ym", "tech_code").agg(
        F.sum("n").cast("bigint").alias("accounts"))


def live_source(panel: DataFrame) -> DataFrame:
    return panel.filter(F.col("ym") >= F.lit(LIVE_FROM)).withColumn("source", F.lit(SRC_LIVE))


def legacy_source(panel: DataFrame) -> DataFrame:
    return panel.filter(F.col("ym") <= F.lit(LEGACY_TO)).withColumn("source", F.lit(SRC_LEGACY))


# --- wide text sources derived from the panel ---------------------------------
# Two all-text wide tables shaped like the original sources: the live one has a
# 'ROC/month' period and a subtotal that leaves out one code; the legacy one has
# separate ROC year and month columns and a total over all five codes.

LIVE_COLS = ("period", "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "subtotal", "5-LOW")
LEGACY_COLS = ("roc_year", "month", "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "total")

ORDERS_LIVE = SourceSpec(
    tag="live", source=SRC_LIVE, columns=LIVE_COLS, period_cols=("period",),
    unpivot={c: c for c in ORDER_CODES},
    sums=SumSpec("subtotal", ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")),
    rows=56, first=(1997, 1), last=(2001, 8), live=True,
)
ORDERS_LEGACY = SourceSpec(
    tag="legacy", source=SRC_LEGACY, columns=LEGACY_COLS, period_cols=("roc_year", "month"),
    unpivot={c: c for c in ORDER_CODES},
    sums=SumSpec("total", tuple(ORDER_CODES)),
    rows=44, first=(1995, 1), last=(1998, 8), live=False,
)


def wide_text(panel: DataFrame, spec: SourceSpec, measure: str = "cents") -> DataFrame:
    """Pivot the long panel to one all-text row per month, thousands-separated.

    A (month, code) with no orders is a blank (NULL) cell, as in a CSV.
    """
    src = live_source(panel) if spec.live else legacy_source(panel)
    # internal names stay plain identifiers; the spec's header is applied last
    aggs = [F.sum(F.when(F.col("tech_code") == c, F.col(measure))).alias(f"_v{i}")
            for i, c in enumerate(ORDER_CODES)]
    aggs.append(F.sum(F.when(F.col("tech_code").isin(*spec.sums.parts), F.col(measure))).alias("_sum"))
    w = src.groupBy("ym").agg(*aggs)
    inner = {c: f"_v{i}" for i, c in enumerate(ORDER_CODES)}
    inner[spec.sums.total] = "_sum"
    roc = (F.year("ym") - ROC_OFFSET).cast("string")
    mon = F.month("ym").cast("string")
    if spec.live:
        period = [F.concat(roc, F.lit("/"), mon).alias("_p")]
    else:
        period = [roc.alias("_p0"), mon.alias("_p1")]
    body = [thousands(F.col(inner[c])).alias(inner[c]) for c in spec.columns if c not in spec.period_cols]
    names = dict(zip(spec.period_cols, ["_p"] if spec.live else ["_p0", "_p1"]))
    names.update(inner)
    return w.select(*period, *body).select(*[F.col(names[c]).alias(c) for c in spec.columns])
