"""Headline numbers and report series from the metrics table.

All inputs are at month grain (one row per month and dims), produced by
:func:`panelforge.operators.metrics.panel_metrics` with ``ym`` as 'yyyy-MM'
text (text order is month order). Windows are partitioned by dims; with no
dims they run over a few hundred rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.periods import parse_ym, years_between
from .joins import bounded_broadcast
from ..sources.literal import literal_table


def _share(spec) -> str:
    return f"{spec.p}_share"


def headline_delta(metrics: DataFrame, spec, anchor_ym: str, dims=()) -> DataFrame:
    """Share at the latest month with a share minus share at the anchor.

    ``latest`` is the last month whose share is defined (a month missing a
    group has a NULL share, T9). ``years`` is rounded half-even.
    """
    s = _share(spec)
    ok = metrics.filter(F.col(s).isNotNull())
    g = ok.groupBy(*dims).agg(
        F.max("ym").alias("latest_ym"),
        F.max_by(s, "ym").alias("latest_share"),
        F.max(F.when(F.col("ym") == anchor_ym, F.col(s))).alias("anchor_share"),
    )
    return g.select(
        *dims, F.lit(anchor_ym).alias("anchor_ym"), "latest_ym", "anchor_share", "latest_share",
        F.round(F.col("latest_share") - F.col("anchor_share"), 4).alias("delta_pp"),
        years_between(parse_ym(F.lit(anchor_ym)), parse_ym(F.col("latest_ym"))).alias("years"),
    )


def with_share_change(metrics: DataFrame, spec, dims=()) -> DataFrame:
    """Adds ``share_change`` (pp vs the previous row)."""
    s = _share(spec)
    w = Window.partitionBy(*dims).orderBy("ym")
    return metrics.withColumn("share_change", F.round(F.col(s) - F.lag(s).over(w), 4))


def break_neighbourhood(metrics: DataFrame, spec, breaks, dims=()) -> DataFrame:
    """Rows before, at and after each flagged month, with nets and share change."""
    s = _share(spec)
    w = Window.partitionBy(*dims).orderBy("ym")
    m = with_share_change(metrics, spec, dims)
    flag = F.col("ym").isin(*breaks)
    m = (m.withColumn("__at", flag)
         .withColumn("__before", F.coalesce(F.lead(flag).over(w), F.lit(False)))
         .withColumn("__after", F.coalesce(F.lag(flag).over(w), F.lit(False))))
    pos = (F.when(F.col("__at"), "break").when(F.col("__before"), "before").when(F.col("__after"), "after"))
    return m.where(F.col("__at") | F.col("__before") | F.col("__after")).select(
        *dims, "ym", pos.alias("position"), f"{spec.p}_net", f"{spec.s}_net", s, "share_change")


def break_impact(metrics: DataFrame, spec, breaks, anchor_ym: str, dims=()) -> DataFrame:
    """H3: a break's one-month jump, its share of the anchor→latest delta, the residual.

    The delta comes from whole-partition window aggregates (same partitioning
    as the other windows), so no join is needed.
    """
    s = _share(spec)
    whole = Window.partitionBy(*dims)
    latest = F.max_by(F.col(s), F.when(F.col(s).isNotNull(), F.col("ym"))).over(whole)
    anchor = F.max(F.when(F.col("ym") == anchor_ym, F.col(s))).over(whole)
    m = with_share_change(metrics, spec, dims).withColumn("delta_pp", F.round(latest - anchor, 4))
    return m.filter(F.col("ym").isin(*breaks)).select(
        *dims, "ym", F.col("share_change").alias("jump_pp"), "delta_pp",
        F.round(F.abs(F.col("share_change") / F.nullif(F.col("delta_pp"), F.lit(0.0))) * 100, 2)
        .alias("pct_of_delta"),
        F.round(F.col("delta_pp") - F.col("share_change"), 4).alias("residual_pp"),
    )


def annotations(spark: SparkSession, events, breaks) -> DataFrame:
    """Events (date, label, source) and breaks (date, label) as one small table."""
    rows = [(d, label, src, "event") for d, label, src in events]
    rows += [(d, label, None, "break") for d, label in breaks]
    return literal_table(spark, rows, "date date, label string, source string, kind string")


def annotated_series(metrics: DataFrame, notes: DataFrame, spec, n_notes: int | None = None) -> DataFrame:
    """Attach annotations to their month (a mid-month date lands on its month).

    ``notes`` is a literal list fixed in the spec; pass its length as
    ``n_notes`` and it is broadcast when under the row limit.
    """
    n = notes.select(F.date_format(F.trunc("date", "MM"), "yyyy-MM").alias("ym"), "label", "kind")
    side = bounded_broadcast(n, n_notes) if n_notes is not None else n
    return metrics.select("ym", f"{spec.p}_share").join(side, "ym", "left")


def gap_series(metrics: DataFrame, spec, anchor_ym: str, dims=()) -> DataFrame:
    """Share, complement, gap, anchor flag and the joint value range."""
    s = _share(spec)
    w = Window.partitionBy(*dims)
    comp = F.round(F.lit(100.0) - F.col(s), 4)
    lo = F.least(F.min(s).over(w), F.lit(100.0) - F.max(s).over(w)) - 5
    hi = F.greatest(F.max(s).over(w), F.lit(100.0) - F.min(s).over(w)) + 5
    return metrics.select(
        *dims, "ym", s, comp.alias(f"{spec.s}_share"),
        F.round(F.col(s) - comp, 4).alias("gap_pp"),
        (F.col("ym") == anchor_ym).alias("is_anchor"),
        F.round(lo, 4).alias("range_lo"), F.round(hi, 4).alias("range_hi"),
    )


def chart_long(metrics: DataFrame, spec) -> DataFrame:
    """The two level series and the two net series in long form."""
    p, s = spec.p, spec.s
    cols = [p, s, f"{p}_net", f"{s}_net"]
    m = metrics.select("ym", *[F.col(c).cast("double").alias(c) for c in cols])
    return m.unpivot(["ym"], cols, "series", "value")


def last_n(metrics: DataFrame, n: int, cols) -> DataFrame:
    """L3: the last ``n`` months (TakeOrderedAndProject: a per-task top-n, no full sort)."""
    return metrics.orderBy(F.col("ym").desc()).limit(n).select(*cols)


def anchor_check(metrics: DataFrame, expected: DataFrame, spec, tol: float = 0.005) -> DataFrame:
    """Metric row vs expected anchor values; exact levels, share within ``tol``."""
    s = _share(spec)
    j = expected.join(metrics.select("ym", spec.p, spec.s, s), "ym", "left")
    return j.select(
        "ym",
        (F.col(spec.p) == F.col(f"exp_{spec.p}")).alias(f"{spec.p}_ok"),
        (F.col(spec.s) == F.col(f"exp_{spec.s}")).alias(f"{spec.s}_ok"),
        (F.abs(F.col(s) - F.col("exp_share")) < tol).alias("share_ok"),
        F.round(F.col(s), 2).alias("share_2dp"),
        "exp_share",
    )
