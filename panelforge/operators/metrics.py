"""Group levels, share, net change, trailing average, cumulative net.

Input is a long panel ``(ym DATE, tech_code, accounts, *dims)``. Output has one
row per ``(ym, *dims)``. The original windows are global; here every window
is ``partitionBy(*dims)``, so with extra dimensions the work spreads over
partitions, and with ``dims=[]`` the input to the window is already at month
grain (a few hundred rows) after a partial + final aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.periods import ym_text
from ..spec import MA_WINDOW, PanelSpec
from .joins import bounded_broadcast
from ..sources.literal import literal_table


def group_dim(spark: SparkSession, spec: PanelSpec) -> DataFrame:
    """The category dimension (code, name, group) as a tiny literal table.

    Its size is the spec's code list, fixed before the data is read, so
    broadcasting it is bounded by construction.
    """
    rows = [(c, spec.names.get(c, c), g) for c, g in sorted(spec.groups.items())]
    return literal_table(spark, rows, "tech_code string, tech_name string, camp string")


def with_group(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Attach the group by a broadcast join on ``tech_code``."""
    dim = group_dim(panel.sparkSession, spec).select("tech_code", "camp")
    return panel.join(bounded_broadcast(dim, len(spec.groups)), "tech_code")


def group_levels(panel: DataFrame, spec: PanelSpec, dims=(), measure: str = "accounts") -> DataFrame:
    """M1/M2 (G1 + P5): per month, the sum of each of the two groups and their total.

    A month with no row for one group keeps NULL for it (and for the total):
    NULL is not coalesced to 0.
    """
    p, s = spec.p, spec.s
    g = with_group(panel, spec).filter(F.col("camp").isin(spec.primary, spec.secondary))
    lv = g.groupBy("ym", *dims).agg(
        F.sum(F.when(F.col("camp") == spec.primary, F.col(measure))).cast("bigint").alias(p),
        F.sum(F.when(F.col("camp") == spec.secondary, F.col(measure))).cast("bigint").alias(s),
    )
    return lv.withColumn("total", F.col(p) + F.col(s))


def share_expr(num: Column, total: Column, scale: int = 4) -> Column:
    """M3/T5: ROUND(num::numeric / total * 100, 4) on exact decimals.

    Both sides are DECIMAL(20,0), so the quotient keeps 18 fraction digits
    before the half-up rounding. A zero total gives NULL rather than an error.
    """
    q = num.cast("decimal(20,0)") / F.nullif(total, F.lit(0)).cast("decimal(20,0)")
    return F.round(q * 100, scale).cast("double")


def panel_metrics(levels: DataFrame, spec: PanelSpec, dims=(), window: int = MA_WINDOW,
                  ym_as_text: bool = True) -> DataFrame:
    """M7: the 11-column metric table (plus dims) from group levels.

    W1 row_number, W2 first difference (first row NULL), W3 trailing average of
    ``window`` rows rounded to 1 decimal and NULL until the window is full,
    W4 cumulative net (NULL on the first row, NULLs skipped after that).
    Windows that share a partition and order share one sort.
    """
    return _metric_rows(levels, spec, dims, window, ym_as_text)


def _metric_rows(levels: DataFrame, spec: PanelSpec, dims, window: int, ym_as_text: bool,
                 fresh: Column | None = None, carried=None) -> DataFrame:
    """Rows of :func:`panel_metrics`; with ``fresh`` only those rows come out, the others are what lies before them.

    The cumulative columns then go on from ``carried`` (a column for each group) of the last row before.
    """
    p, s = spec.p, spec.s
    w = Window.partitionBy(*dims).orderBy("ym")
    wt = w.rowsBetween(-(window - 1), Window.currentRow)
    base = (
        levels.withColumn("rn", F.row_number().over(w))
        .withColumn(f"{p}_net", F.col(p) - F.lag(p).over(w))
        .withColumn(f"{s}_net", F.col(s) - F.lag(s).over(w))
    )

    def trailing(c: str) -> Column:
        avg = F.avg(F.col(c).cast("decimal(20,0)")).over(wt)
        return F.when(F.col("rn") >= window, F.round(avg, 1)).cast("double")

    def running(c: str) -> Column:
        if fresh is None:
            return F.sum(f"{c}_net").over(w)
        new, old = F.sum(F.when(fresh, F.col(f"{c}_net"))).over(w), F.last(F.when(~fresh, F.col(carried[c])), True).over(w)
        return F.when(new.isNotNull() | old.isNotNull(), F.coalesce(new, F.lit(0)) + F.coalesce(old, F.lit(0)))

    out = base.select(
        *dims,
        (ym_text(F.col("ym")) if ym_as_text else F.col("ym")).alias("ym"),
        p, s, "total",
        share_expr(F.col(p), F.col("total")).alias(f"{p}_share"),
        f"{p}_net", f"{s}_net",
        trailing(p).alias(f"{p}_ma12"),
        trailing(s).alias(f"{s}_ma12"),
        running(p).cast("bigint").alias(f"{p}_cum_net"),
        running(s).cast("bigint").alias(f"{s}_cum_net"),
        *([] if fresh is None else [fresh.alias("__fresh")]),
    )
    return out if fresh is None else out.where("__fresh").drop("__fresh")


def metrics_tail(stored: DataFrame, changed: DataFrame, spec: PanelSpec, dims=(), window: int = MA_WINDOW) -> DataFrame:
    """M7 incrementally: the metric rows from the first changed month on, by ``dims``.

    ``stored`` is an earlier metric table with ``ym`` as a date; ``changed`` has ``ym, *dims`` and the levels of new or
    changed months. Windows run over the months from the first changed one on and the ``window - 1`` stored rows before
    it; the cumulative columns go on from the last of these. No fact row is read. Series without a change give no rows.
    """
    p, s = spec.p, spec.s
    keys, levels = [*dims, "ym"], [p, s, "total"]
    carried = {c: f"{c}_cum_net" for c in (p, s)}
    first = changed.groupBy(*dims).agg(F.min("ym").alias("__first"))
    if dims:
        near = stored.join(first, list(dims))
    else:
        near = stored.withColumn("__first", first.scalar()).where("__first IS NOT NULL")
    back = Window.partitionBy(*dims).orderBy(F.col("ym").desc())
    before = near.where("ym < __first").withColumn("__k", F.row_number().over(back)).where(F.col("__k") < window)
    after = near.where("ym >= __first").select(*keys, *levels).join(changed.select(*keys), keys, "left_anti")
    new = after.unionByName(changed.select(*keys, *levels))
    rows = before.select(*keys, *levels, *carried.values(), F.lit(False).alias("__new")).unionByName(
        new.select(*keys, *levels, *[F.lit(None).cast("bigint").alias(c) for c in carried.values()], F.lit(True).alias("__new")))
    rows = rows.select(*keys, *levels, *[F.col(c).alias(f"__{c}") for c in carried.values()], "__new")
    return _metric_rows(rows, spec, dims, window, False, F.col("__new"), {k: f"__{c}" for k, c in carried.items()})


def share_change(metrics: DataFrame, spec: PanelSpec, dims=()) -> DataFrame:
    """Share minus the previous row's share, in percentage points."""
    col = f"{spec.p}_share"
    w = Window.partitionBy(*dims).orderBy("ym")
    return metrics.select(
        *dims, "ym", col,
        F.round(F.col(col) - F.lag(col).over(w), 4).alias("share_change_pp"),
    )
