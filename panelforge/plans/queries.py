"""Registered queries: name → callable(spark, sf_dir) → DataFrame.

Every query reads the driver's tables (or data Spark derives from them) in
full; none samples, caps or filters by id to stay cheap. Each has a DuckDB
twin in :mod:`panelforge.plans.oracle` unless noted there.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from ..operators import metrics as M
from ..session import tune
from . import panel as P

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        REGISTRY[name] = run
        return run
    return deco


S = P.ORDERS_SPEC


def _levels(spark, sf_dir):
    return M.group_levels(P.orders_panel(spark, sf_dir), S)


@register("camp_monthly")
def camp_monthly(spark, sf_dir):
    """Group levels per month."""
    from ..functions.periods import ym_text
    lv = _levels(spark, sf_dir)
    return lv.select(ym_text(lv.ym).alias("ym"), "a", "b", "total")


@register("panel_metrics")
def panel_metrics(spark, sf_dir):
    """M1-M7 (flagship): 11 metric columns per month, ordered by month."""
    return M.panel_metrics(_levels(spark, sf_dir), S).orderBy("ym")


@register("panel_metrics_by_region")
def panel_metrics_by_region(spark, sf_dir):
    """M7 with dims=['r_name']: windows partitioned by region."""
    lv = M.group_levels(P.orders_panel_by_region(spark, sf_dir), S, dims=["r_name"])
    return M.panel_metrics(lv, S, dims=["r_name"])


# --- normalisation and scalar rules ------------------------------------------

def _wide(spark, sf_dir, spec):
    return P.wide_text(P.orders_panel(spark, sf_dir), spec)


@register("unpivot_cells")
def unpivot_cells(spark, sf_dir):
    """Both wide texts → one parsed row per (source, month, code)."""
    from pyspark.sql import functions as F

    from ..functions.periods import ym_text
    from ..operators.normalize import parse_cells
    from ..operators.normalize import unpivot_cells as unpivot
    live, legacy = (unpivot(_wide(spark, sf_dir, s), s) for s in (P.ORDERS_LIVE, P.ORDERS_LEGACY))
    cells = parse_cells(live.unionByName(legacy))
    return cells.select(ym_text(F.col("ym")).alias("ym"), "tech_code", "raw", "accounts",
                        "reason", "source")


@register("parse_thousands")
def parse_thousands(spark, sf_dir):
    """Format every panel measure with separators, parse it back."""
    from pyspark.sql import functions as F

    from ..functions.parse import has_comma, parse_reason, strict_int, thousands
    from ..functions.periods import ym_text
    p = P.orders_panel(spark, sf_dir)
    t = p.select("ym", "tech_code", "cents", thousands(F.col("cents")).alias("text"))
    return t.select(
        ym_text(F.col("ym")).alias("ym"), "tech_code", "text",
        strict_int(F.col("text")).alias("value"),
        parse_reason(F.col("text")).alias("reason"),
        has_comma(F.col("text")).alias("has_comma"),
        (strict_int(F.col("text")) == F.col("cents")).alias("roundtrip_ok"),
    )


@register("roc_period")
def roc_period(spark, sf_dir):
    """F3-F7 P11: 'ROC/month' text, or ROC year and month texts → year, month, ROC year, quarter, 'yyyy-MM'."""
    from pyspark.sql import functions as F

    from ..functions.periods import ad_to_roc, ym_text
    from ..operators.normalize import period_columns
    live = period_columns(_wide(spark, sf_dir, P.ORDERS_LIVE), P.ORDERS_LIVE)
    legacy = period_columns(_wide(spark, sf_dir, P.ORDERS_LEGACY).withColumnRenamed("month", "roc_month"),
                            replace(P.ORDERS_LEGACY, period_cols=("roc_year", "roc_month")))
    legacy = legacy.withColumn("period", F.concat_ws(" ", "roc_year", "roc_month"))
    cols = ["period", "year", "month", "ym"]
    w = live.select(F.lit(P.SRC_LIVE).alias("source"), *cols).unionByName(
        legacy.select(F.lit(P.SRC_LEGACY).alias("source"), *cols))
    return w.select(
        "source", "period", "year", "month",
        ad_to_roc(F.col("year")).alias("roc_year"),
        F.quarter("ym").alias("quarter"),
        ym_text(F.col("ym")).alias("ym"),
    )


# --- contracts -----------------------------------------------------------------

@register("contract_summary")
def contract_summary(spark, sf_dir):
    """One aggregation pass per source, 8 check rows each."""
    from ..operators.contracts import content_checks
    live = content_checks(_wide(spark, sf_dir, P.ORDERS_LIVE), P.ORDERS_LIVE)
    legacy = content_checks(_wide(spark, sf_dir, P.ORDERS_LEGACY), P.ORDERS_LEGACY)
    return live.unionByName(legacy)


@register("evidence_top_n")
def evidence_top_n(spark, sf_dir):
    """L4: first 3 failing cells / rows per check and source, by period."""
    from ..operators.contracts import contract_evidence
    live = contract_evidence(_wide(spark, sf_dir, P.ORDERS_LIVE), P.ORDERS_LIVE, 3)
    legacy = contract_evidence(_wide(spark, sf_dir, P.ORDERS_LEGACY), P.ORDERS_LEGACY, 3)
    return live.unionByName(legacy)


# --- keyed-table contracts ---------------------------------------------------

@register("subtotal_classes")
def subtotal_classes(spark, sf_dir):
    """Each order total vs the sum of its line amounts → class counts.

    lineitem is partially aggregated per order first; the join then reuses
    that hash partitioning on the order key (one exchange per side).
    """
    from pyspark.sql import functions as F

    from ..functions.parse import subtotal_class
    from ..sources.tables import read_table
    from ..spec import TOLERANCE
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_extendedprice", "l_tax", "l_discount")
    parts = li.groupBy("l_orderkey").agg(F.sum(P.line_amount_cents()).alias("parts"))
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    j = o.join(parts, o.o_orderkey == parts.l_orderkey, "left")
    cls = subtotal_class(P.cents("o_totalprice"), F.coalesce(F.col("parts"), F.lit(0)), TOLERANCE)
    return j.groupBy(cls.alias("class")).agg(F.count(F.lit(1)).alias("n_orders"))


@register("duplicate_keys")
def duplicate_keys_q(spark, sf_dir):
    """(l_orderkey, l_linenumber) keys that occur more than once."""
    from ..operators.contracts import duplicate_keys
    from ..sources.tables import read_table
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber")
    return duplicate_keys(li, ["l_orderkey", "l_linenumber"])


@register("missing_months")
def missing_months(spark, sf_dir):
    """Per code, breaks in its monthly series and the months missed."""
    from pyspark.sql import functions as F

    from ..functions.periods import ym_text
    from ..operators.contracts import month_gaps
    g = month_gaps(P.orders_panel(spark, sf_dir), dims=["tech_code"])
    return g.select("tech_code", ym_text(F.col("ym")).alias("ym"),
                    ym_text(F.col("next_ym")).alias("next_ym"), "n_missing")


FK_RELATIONS = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
]


@register("fk_orphans")
def fk_orphans(spark, sf_dir):
    """Child rows without a parent, all relations in one pass over each table."""
    from ..operators.contracts import orphan_counts
    from ..sources.tables import read_table
    return orphan_counts(lambda t, *cols: read_table(spark, sf_dir, t, *cols), FK_RELATIONS)


SPARSE_RELATIONS = [
    ("orders", "o_orderkey", "lineitem", "l_orderkey"),
    ("labels", "doc_id", "pages", "page_id"),
]


@register("fk_orphans_sparse")
def fk_orphans_sparse(spark, sf_dir):
    """Relations that do not hold for all rows: orders without lines, labels without a page."""
    from ..operators.contracts import orphan_counts
    from ..sources.tables import read_table
    return orphan_counts(lambda t, *cols: read_table(spark, sf_dir, t, *cols), SPARSE_RELATIONS)


@register("domain_violations_found")
def domain_violations_found(spark, sf_dir):
    """Rules that some lines and orders break."""
    from pyspark.sql import functions as F

    from ..operators.contracts import violation_counts
    from ..sources.tables import read_table
    li = read_table(spark, sf_dir, "lineitem", "l_quantity", "l_extendedprice", "l_discount", "l_linenumber")
    a = violation_counts(li, {
        "l_quantity_le_45": F.col("l_quantity") > 45,
        "l_extendedprice_ge_1000": F.col("l_extendedprice") < 1000,
        "l_linenumber_1_6": ~F.col("l_linenumber").between(1, 6),
    })
    o = read_table(spark, sf_dir, "orders", "o_totalprice", "o_orderstatus")
    b = violation_counts(o, {
        "o_totalprice_ge_10000": F.col("o_totalprice") < 10000,
        "o_orderstatus_closed": ~F.col("o_orderstatus").isin("F", "O"),
    })
    return a.select(F.lit("lineitem").alias("table"), "*").unionByName(b.select(F.lit("orders").alias("table"), "*"))


@register("domain_violations")
def domain_violations(spark, sf_dir):
    """One aggregation pass per table, one count per rule."""
    from pyspark.sql import functions as F

    from ..operators.contracts import not_null_rules, violation_counts
    from ..sources.tables import read_table
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity",
                    "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    li_rules = {
        **not_null_rules(["l_orderkey", "l_linenumber", "l_shipdate"]),
        "l_quantity_ge_0": F.col("l_quantity") < 0,
        "l_extendedprice_ge_0": F.col("l_extendedprice") < 0,
        "l_discount_0_1": ~F.col("l_discount").between(0, 1),
        "l_tax_0_1": ~F.col("l_tax").between(0, 1),
        "l_linenumber_1_7": ~F.col("l_linenumber").between(1, 7),
    }
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderdate", "o_orderstatus")
    o_rules = {
        **not_null_rules(["o_orderkey", "o_orderdate"]),
        "o_totalprice_ge_0": F.col("o_totalprice") < 0,
        "o_orderstatus_domain": ~F.col("o_orderstatus").isin("F", "O", "P"),
        "o_month_1_12": ~F.month("o_orderdate").between(1, 12),
    }
    a = violation_counts(li, li_rules).select(F.lit("lineitem").alias("table"), "*")
    b = violation_counts(o, o_rules).select(F.lit("orders").alias("table"), "*")
    return a.unionByName(b)


@register("cell_completeness")
def cell_completeness(spark, sf_dir):
    """Codes present per month and whether the month is complete."""
    from pyspark.sql import functions as F

    from ..functions.periods import ym_text
    p = P.orders_panel(spark, sf_dir)
    g = p.groupBy("ym").agg(F.count_distinct("tech_code").alias("n_codes"))
    return g.select(ym_text(F.col("ym")).alias("ym"), "n_codes",
                    (F.col("n_codes") == len(P.ORDER_CODES)).alias("complete"))


# --- overlap, verdict, splice --------------------------------------------------

def _sources(spark, sf_dir):
    panel = P.orders_panel(spark, sf_dir)
    return P.live_source(panel), P.legacy_source(panel)


def _differing(spark, sf_dir):
    """The live source over all orders, and a legacy one over the orders that have lines."""
    return P.live_source(P.orders_panel(spark, sf_dir)), P.legacy_source(P.lines_panel(spark, sf_dir))


def _overlap_stats(detail):
    from pyspark.sql import functions as F

    from ..operators.splice import overlap_stats
    overall = overlap_stats(detail).select(F.lit("ALL").alias("tech_code"), "*")
    return overall.unionByName(overlap_stats(detail, ["tech_code"]))


def _perturbed(b):
    """Failing variant: legacy counts inflated by ceil(6 %), so the median diff > 5 %."""
    from pyspark.sql import functions as F
    return b.withColumn("accounts", F.col("accounts") + F.ceil(F.col("accounts") * 0.06).cast("bigint"))


def _txt_ym(df, *cols):
    from pyspark.sql import functions as F

    from ..functions.periods import ym_text
    for c in cols:
        df = df.withColumn(c, ym_text(F.col(c)))
    return df


@register("overlap_periods")
def overlap_periods_q(spark, sf_dir):
    """Months both sources cover."""
    from ..operators.splice import overlap_periods
    a, b = _sources(spark, sf_dir)
    return _txt_ym(overlap_periods(a, b), "ym")


@register("overlap_detail")
def overlap_detail_q(spark, sf_dir):
    """Per overlap month × comparable code: a, b, delta, pct, status."""
    from ..operators.splice import overlap_detail
    a, b = _sources(spark, sf_dir)
    return _txt_ym(overlap_detail(a, b, S.comparable), "ym")


@register("overlap_stats")
def overlap_stats_q(spark, sf_dir):
    """Median / max / exact count of pct, overall ('ALL') and per code."""
    from ..operators.splice import overlap_detail
    a, b = _sources(spark, sf_dir)
    return _overlap_stats(overlap_detail(a, b, S.comparable))


@register("overlap_stats_lines")
def overlap_stats_lines(spark, sf_dir):
    """K2 G6 G7 where the sources differ: all orders against the orders that have lines."""
    from ..operators.splice import overlap_detail
    a, b = _differing(spark, sf_dir)
    return _overlap_stats(overlap_detail(a, b, S.comparable))


@register("splice_verdict_lines")
def splice_verdict_lines(spark, sf_dir):
    """K3 where the sources differ: all orders against the orders that have lines."""
    from ..operators.splice import overlap_detail, splice_verdict
    a, b = _differing(spark, sf_dir)
    return splice_verdict(overlap_detail(a, b, S.comparable), S.threshold_pct)


@register("overlap_detail_by_nation")
def overlap_detail_by_nation(spark, sf_dir):
    """K1 T1 by nation, where keys are missing on one side or on both."""
    from ..operators.splice import overlap_detail
    from ..sources.tables import read_table
    cols = ("o_custkey", "o_orderdate", "o_orderpriority")
    a = P.nation_panel(spark, sf_dir, read_table(spark, sf_dir, "orders", *cols))
    b = P.nation_panel(spark, sf_dir, P.orders_with_lines(spark, sf_dir, *cols))
    return _txt_ym(overlap_detail(P.live_source(a), P.legacy_source(b), S.comparable, ["n_name"]), "ym")


@register("splice_verdict")
def splice_verdict_q(spark, sf_dir):
    """One verdict row for the live/legacy overlap."""
    from ..operators.splice import overlap_detail, splice_verdict
    a, b = _sources(spark, sf_dir)
    return splice_verdict(overlap_detail(a, b, S.comparable), S.threshold_pct)


@register("splice_verdict_perturbed")
def splice_verdict_perturbed(spark, sf_dir):
    """K3 abandon branch: same overlap with the legacy counts inflated by 6 %."""
    from ..operators.splice import overlap_detail, splice_verdict
    a, b = _sources(spark, sf_dir)
    return splice_verdict(overlap_detail(a, _perturbed(b), S.comparable), S.threshold_pct)


@register("spliced_panel")
def spliced_panel(spark, sf_dir):
    """Legacy before the cutover, live from it on."""
    from ..operators.splice import splice
    a, b = _sources(spark, sf_dir)
    out = splice(a, b, S.cutover).select("ym", "tech_code", "accounts", "source")
    return _txt_ym(out, "ym").orderBy("ym", "tech_code")


@register("splice_fallback")
def splice_fallback(spark, sf_dir):
    """K5: the live source alone (what an abandoned splice presents)."""
    from ..operators.splice import fallback
    a, _ = _sources(spark, sf_dir)
    return _txt_ym(fallback(a).select("ym", "tech_code", "accounts", "source"), "ym")


@register("post_splice_shape")
def post_splice_shape(spark, sf_dir):
    """K7: first / last month, months and rows of the spliced panel."""
    from ..operators.splice import shape, splice
    a, b = _sources(spark, sf_dir)
    return _txt_ym(shape(splice(a, b, S.cutover)), "first_ym", "last_ym")


@register("provenance_by_source")
def provenance_by_source(spark, sf_dir):
    """Per source rows, first / last month and rows on the wrong side of the cutover."""
    from pyspark.sql import functions as F

    from ..operators.splice import provenance_violations, splice
    a, b = _sources(spark, sf_dir)
    s = splice(a, b, S.cutover)
    bad = provenance_violations(s, S.cutover, P.SRC_LIVE, P.SRC_LEGACY)
    g = s.groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"), F.min("ym").alias("first_ym"),
                                F.max("ym").alias("last_ym"), F.count_if(bad).alias("n_wrong_side"))
    return _txt_ym(g, "first_ym", "last_ym")


# --- star schema, merge, fingerprints ------------------------------------------

def _fact(df):
    from pyspark.sql import functions as F
    return df.select(F.col("ym").alias("year_month"), "tech_code", "accounts", "source")


def _spliced_fact(spark, sf_dir):
    from ..operators.splice import splice
    a, b = _sources(spark, sf_dir)
    return _fact(splice(a, b, S.cutover))


@register("upsert_result")
def upsert_result(spark, sf_dir):
    """Legacy state merged with the live batch (batch wins on key, nothing deleted)."""
    from ..operators.warehouse import FACT_KEY, merge_frames
    a, b = _sources(spark, sf_dir)
    return _txt_ym(merge_frames(_fact(b), _fact(a), FACT_KEY, "update"), "year_month")


@register("upsert_ignore")
def upsert_ignore(spark, sf_dir):
    """dim_period insert-ignore — months of the live batch added only when new."""
    from ..operators.warehouse import dim_period, merge_frames
    a, b = _sources(spark, sf_dir)
    return _txt_ym(merge_frames(dim_period(b), dim_period(a), ["year_month"], "ignore"), "year_month")


@register("state_snapshot")
def state_snapshot(spark, sf_dir):
    """Count, sum, range, codes and ordered md5 of the spliced fact."""
    from ..operators.warehouse import snapshot
    return snapshot(_spliced_fact(spark, sf_dir))


@register("fingerprint_keyed")
def fingerprint_keyed(spark, sf_dir):
    """Two-level ordered md5 (per month, then over months) of the spliced fact."""
    from ..operators.fingerprint import ordered_fingerprint
    from ..operators.warehouse import FACT_COLS, FACT_KEY
    return ordered_fingerprint(_spliced_fact(spark, sf_dir), "year_month", FACT_KEY, FACT_COLS)


LINEITEM_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
LINEITEM_HUNDREDTHS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_TEXTS = ["l_returnflag", "l_linestatus"]


@register("fingerprint_unkeyed")
def fingerprint_unkeyed(spark, sf_dir):
    """Order-insensitive fingerprint of all of lineitem (no shuffle of rows)."""
    from pyspark.sql import functions as F

    from ..operators.fingerprint import unordered_fingerprint
    from ..sources.tables import read_table
    li = read_table(spark, sf_dir, "lineitem", *LINEITEM_KEYS, *LINEITEM_HUNDREDTHS, *LINEITEM_TEXTS, "l_shipdate")
    hundredths = [F.floor(F.col(c) * 100 + 0.5) for c in LINEITEM_HUNDREDTHS]
    days = F.unix_date(F.col("l_shipdate").cast("date"))
    return unordered_fingerprint(li, [*LINEITEM_KEYS, *hundredths, *LINEITEM_TEXTS, days], "md5")


@register("summary_by_camp")
def summary_by_camp(spark, sf_dir):
    """Per group rows, distinct codes, first / last month of the spliced fact."""
    from pyspark.sql import functions as F

    from ..operators.metrics import group_dim
    from ..operators.joins import bounded_broadcast
    f = _spliced_fact(spark, sf_dir)
    j = f.join(bounded_broadcast(group_dim(spark, S).select("tech_code", "camp"), len(S.groups)), "tech_code")
    g = j.groupBy("camp").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("tech_code").alias("n_tech"),
                              F.min("year_month").alias("first_ym"), F.max("year_month").alias("last_ym"))
    return _txt_ym(g, "first_ym", "last_ym")


@register("latest_period_gate")
def latest_period_gate(spark, sf_dir):
    """Is the staged (live) source ahead of the committed (legacy) state?"""
    from pyspark.sql import functions as F
    a, b = _sources(spark, sf_dir)
    cur = b.agg(F.max("ym").alias("current_ym"), F.lit(1).alias("__k"))
    new = a.agg(F.max("ym").alias("staged_ym"), F.lit(1).alias("__k"))
    u = cur.unionByName(new, allowMissingColumns=True).groupBy("__k").agg(
        F.max("current_ym").alias("current_ym"), F.max("staged_ym").alias("staged_ym"))
    out = u.select("current_ym", "staged_ym",
                   F.coalesce(F.col("staged_ym") > F.col("current_ym"), F.lit(False)).alias("has_new_period"))
    return _txt_ym(out, "current_ym", "staged_ym")


# --- headline, breaks, annotations, anchors -----------------------------------

def _metrics(spark, sf_dir):
    return M.panel_metrics(_levels(spark, sf_dir), S)


@register("share_change")
def share_change(spark, sf_dir):
    """Share and its change vs the previous month."""
    return M.share_change(_metrics(spark, sf_dir), S)


@register("break_neighbourhood")
def break_neighbourhood(spark, sf_dir):
    """Nets, share and share change before / at / after each flagged month."""
    from ..operators.headline import break_neighbourhood as bn
    return bn(_metrics(spark, sf_dir), S, P.BREAK_MONTHS)


@register("break_impact")
def break_impact(spark, sf_dir):
    """H3: one-month jump at each break, its % of the headline delta, the residual."""
    from ..operators.headline import break_impact as bi
    return bi(_metrics(spark, sf_dir), S, P.BREAK_MONTHS, P.ANCHOR_YM)


@register("headline_delta")
def headline_delta(spark, sf_dir):
    """Anchor → latest share delta in pp and whole years between."""
    from ..operators.headline import headline_delta as hd
    return hd(_metrics(spark, sf_dir), S, P.ANCHOR_YM)


@register("annotated_series")
def annotated_series(spark, sf_dir):
    """Monthly share with event / break annotations attached to their month."""
    import datetime as dt

    from ..operators.headline import annotated_series as an
    from ..operators.headline import annotations
    breaks = [(dt.date(int(b[:4]), int(b[5:]), 1), b) for b in P.BREAK_MONTHS]
    notes = annotations(spark, P.ANNOTATIONS, breaks)
    return an(_metrics(spark, sf_dir), notes, S, n_notes=len(P.ANNOTATIONS) + len(breaks))


@register("gap_series")
def gap_series(spark, sf_dir):
    """Share, complement, gap, anchor flag, joint value range."""
    from ..operators.headline import gap_series as gs
    return gs(_metrics(spark, sf_dir), S, P.ANCHOR_YM)


@register("anchor_check")
def anchor_check(spark, sf_dir):
    """Metric rows vs anchors recomputed straight from orders."""
    from pyspark.sql import functions as F

    from ..functions.periods import month_of, ym_text
    from ..operators.headline import anchor_check as ac
    from ..sources.tables import read_table
    o = read_table(spark, sf_dir, "orders", "o_orderdate", "o_orderpriority")
    a_codes = [c for c, g in P.ORDER_GROUPS.items() if g == S.primary]
    b_codes = [c for c, g in P.ORDER_GROUPS.items() if g == S.secondary]
    ym = ym_text(month_of(F.col("o_orderdate")))
    exp = (o.withColumn("ym", ym).filter(F.col("ym").isin(*P.BREAK_MONTHS, P.ANCHOR_YM))
           .groupBy("ym").agg(F.count_if(F.col("o_orderpriority").isin(*a_codes)).alias("exp_a"),
                              F.count_if(F.col("o_orderpriority").isin(*b_codes)).alias("exp_b")))
    exp = exp.withColumn("exp_share", F.round(F.col("exp_a") * 100.0 / (F.col("exp_a") + F.col("exp_b")), 2))
    return ac(_metrics(spark, sf_dir), exp, S)


@register("chart_long")
def chart_long(spark, sf_dir):
    """Level and net series in long form for charting."""
    from ..operators.headline import chart_long as cl
    return cl(_metrics(spark, sf_dir), S)


@register("last_n_periods")
def last_n_periods(spark, sf_dir):
    """L3: the last 3 months of levels."""
    from ..operators.headline import last_n
    return last_n(_metrics(spark, sf_dir), 3, ["ym", "a", "b", "total"])


# --- scale: blocked sums, generator, rollups, sample statistics, JSON ----------

CUM_BLOCK = 1 << 12


@register("cumulative_blocked")
def cumulative_blocked(spark, sf_dir):
    """W4 at scale: running sum of order cents by order key without a global window."""
    from ..operators.scale import blocked_cumsum
    from ..sources.tables import read_table
    o = read_table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice")
    o = o.select("o_orderkey", P.cents("o_totalprice").alias("cents"))
    return blocked_cumsum(o, "o_orderkey", "cents", "cum_cents", CUM_BLOCK)


ROLLUP_CODE = "1-URGENT"
ROLLUP_FROM, ROLLUP_TO = "1996-01-01", "1999-12-01"


@register("region_rollup")
def region_rollup(spark, sf_dir):
    """One code, an inclusive date range, per region SUM and rounded AVG, largest first.

    Both predicates reach the orders scan (PushedFilters); customer joins by
    shuffle, nation / region are broadcast by their measured size.
    """
    from pyspark.sql import functions as F

    from ..operators.scale import rollup
    o = P.orders_region(spark, sf_dir)
    f = o.filter((F.col("o_orderpriority") == ROLLUP_CODE)
                 & F.col("o_orderdate").between(F.lit(ROLLUP_FROM).cast("timestamp_ntz"),
                                                F.lit(ROLLUP_TO).cast("timestamp_ntz")))
    return rollup(f.select("r_name", P.cents("o_totalprice").alias("cents")), "r_name", "cents",
                  "total", "avg_cents")


SCALE_REGIONS = 22


def _scale_inputs(spark, sf_dir):
    """Periods and codes from orders, operators = suppliers; the sizes are two
    small aggregates, taken anew for each call."""
    from pyspark.sql import functions as F

    from ..functions.periods import month_of
    from ..sources.tables import read_table
    o = read_table(spark, sf_dir, "orders", "o_orderdate", "o_orderpriority")
    periods = o.select(month_of(F.col("o_orderdate")).alias("year_month")).distinct()
    codes = o.select(F.col("o_orderpriority").alias("tech_code")).distinct()
    n_supp = read_table(spark, sf_dir, "supplier", "s_suppkey").count()
    sizes = o.agg(F.count_distinct(month_of(F.col("o_orderdate"))).alias("m"),
                  F.count_distinct("o_orderpriority").alias("c")).first()
    return periods, codes, int(sizes["m"]), int(sizes["c"]), n_supp


def _scale_table(spark, sf_dir):
    from ..operators.scale import scale_table
    periods, codes, m, c, n_supp = _scale_inputs(spark, sf_dir)
    return scale_table(spark, periods, codes, SCALE_REGIONS, max(1, n_supp), m, c)


@register("scale_generate")
def scale_generate(spark, sf_dir):
    """Months × codes × 22 regions × one operator per supplier.

    Returned as a per-code summary of the whole generated table.
    """
    from pyspark.sql import functions as F
    t = _scale_table(spark, sf_dir)
    return t.groupBy("tech_code").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("accounts").cast("bigint").alias("sum_accounts"),
        F.min("accounts").alias("min_accounts"), F.max("accounts").alias("max_accounts"),
        F.count_distinct("region_code").alias("n_regions"))


@register("scale_rollup")
def scale_rollup(spark, sf_dir):
    """G5 on the generated table: one code, an inclusive month range, per region."""
    from pyspark.sql import functions as F

    from ..operators.scale import rollup
    t = _scale_table(spark, sf_dir)
    f = t.filter((F.col("tech_code") == ROLLUP_CODE)
                 & F.col("year_month").between(F.lit(ROLLUP_FROM).cast("date"), F.lit(ROLLUP_TO).cast("date")))
    return rollup(f, "region_code", "accounts")


def _phased_events(spark, sf_dir):
    from pyspark.sql import functions as F

    from ..sources.tables import read_table
    e = read_table(spark, sf_dir, "events", "event_type", "ts", "value")
    phase = F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz"), "before").otherwise("after")
    return e.withColumn("phase", phase)


@register("sample_stats")
def sample_stats_q(spark, sf_dir):
    """N, exact median, min, max of event values per type and phase."""
    from ..operators.scale import sample_stats
    return sample_stats(_phased_events(spark, sf_dir), ["event_type", "phase"], "value")


@register("before_after_ratios")
def before_after_ratios(spark, sf_dir):
    """Per type, median before / after, their ratio and the % change."""
    from pyspark.sql import functions as F

    from ..operators.scale import exact_median, ratio
    med = exact_median(_phased_events(spark, sf_dir), ["event_type", "phase"], "value")
    g = med.groupBy("event_type").agg(
        F.max(F.when(F.col("phase") == "before", F.col("median"))).alias("median_before"),
        F.max(F.when(F.col("phase") == "after", F.col("median"))).alias("median_after"))
    r = ratio(F.col("median_before"), F.col("median_after"))
    return g.select("event_type", "median_before", "median_after",
                    F.round(r, 4).alias("ratio"), F.round((F.lit(1.0) - r) * 100, 2).alias("change_pct"))


@register("json_path")
def json_path(spark, sf_dir):
    """A JSON path read from every event's props, summed per type."""
    from pyspark.sql import functions as F

    from ..sources.tables import read_table
    e = read_table(spark, sf_dir, "events", "event_type", "props")
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(k).alias("n_with_k"),
                                       F.sum(k).cast("bigint").alias("sum_k"))


@register("source_invariants")
def source_invariants_q(spark, sf_dir):
    """Per source and code: first month fixed, months dense (== span)."""
    from pyspark.sql import functions as F

    from ..operators.contracts import source_invariants
    a, b = _sources(spark, sf_dir)
    la = source_invariants(a, (1997, 1), dims=["tech_code"]).withColumn("source", F.lit(P.SRC_LIVE))
    lb = source_invariants(b, (1995, 1), dims=["tech_code"]).withColumn("source", F.lit(P.SRC_LEGACY))
    return la.unionByName(lb)


@register("missing_months_by_region")
def missing_months_by_region(spark, sf_dir):
    """C7 W6 with dims: breaks in every (region, code) monthly series."""
    from pyspark.sql import functions as F

    from ..functions.periods import ym_text
    from ..operators.contracts import month_gaps
    g = month_gaps(P.orders_panel_by_region(spark, sf_dir), dims=["r_name", "tech_code"])
    return g.select("r_name", "tech_code", ym_text(F.col("ym")).alias("ym"),
                    ym_text(F.col("next_ym")).alias("next_ym"), "n_missing")


# queries that write and read back tables of their own register themselves
from . import stateful  # noqa: E402, F401
