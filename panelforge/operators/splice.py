"""Compare two overlapping sources, decide, splice.

``a`` is the primary (live) source and ``b`` the secondary (legacy) one; both
are long records ``(ym, tech_code, accounts, source, *dims)``.

* The expected overlap keys are the months both sources cover (U1) times the
  comparable codes. Both sources are grouped by month in one aggregate with one
  value per side and code, so a key missing on either side is reported instead
  of silently dropped (T1), and duplicate keys are counted instead of fanning
  out. There is no join.
* The verdict ``median(pct) > threshold`` is decided from counts (one partial
  aggregate, no values held in memory): with n values and k above the
  threshold the median is above it iff k > n/2, except when n is even and
  k = n/2, where the two middle values are the largest value ≤ threshold and
  the smallest value > threshold. The exact median is still reported.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import pct_diff
from .scale import exact_median, median_bracket, median_in_bracket

KEY = ["ym", "tech_code"]


def overlap_periods(a: DataFrame, b: DataFrame, dims=()) -> DataFrame:
    """Months (per dims) present in both sources."""
    return a.select(*dims, "ym").distinct().intersect(b.select(*dims, "ym").distinct())


def overlap_detail(a: DataFrame, b: DataFrame, comparable, dims=()) -> DataFrame:
    """One row per overlap month × comparable code (× dims).

    ``v_a``, ``v_b``, ``delta = v_a - v_b``, ``pct`` (denominator ``v_a``),
    ``status`` ∈ {both, missing_a, missing_b, missing_both},
    ``n_a``/``n_b`` = how many rows each side has for the key (1 when clean).

    One pass: the union of both sources, tagged by side, is grouped by month
    with one value and count per side and code; months that only one side has
    are left out (U1), and the rest become one row per code.
    """
    keep = [*dims, *KEY, "accounts"]
    tagged = a.select(*keep, F.lit(True).alias("__a")).unionByName(b.select(*keep, F.lit(False).alias("__a")))
    aggs = [F.count_if("__a").alias("__in_a"), F.count_if(~F.col("__a")).alias("__in_b")]
    for i, code in enumerate(comparable):
        hit = (F.col("tech_code") == code) & F.col("ym").isNotNull()     # a null month matches no month
        for side, here in (("a", hit & F.col("__a")), ("b", hit & ~F.col("__a"))):
            aggs += [F.max(F.when(here, F.col("accounts"))).alias(f"__v_{side}{i}"), F.count_if(here).alias(f"__n_{side}{i}")]
    months = tagged.groupBy(*dims, "ym").agg(*aggs).where("__in_a > 0 and __in_b > 0")
    per_code = F.array(*[F.struct(F.lit(code).alias("tech_code"), *[F.col(f"__{x}{i}").alias(x) for x in ("v_a", "v_b", "n_a", "n_b")])
                         for i, code in enumerate(comparable)])
    j = months.select(*dims, "ym", F.inline(per_code))
    # a key whose only values are NULL (unparsed) counts as missing on that side
    status = (F.when(F.col("v_a").isNull() & F.col("v_b").isNull(), "missing_both")
              .when(F.col("v_a").isNull(), "missing_a")
              .when(F.col("v_b").isNull(), "missing_b")
              .otherwise("both"))
    return j.select(
        *dims, *KEY, "v_a", "v_b",
        (F.col("v_a") - F.col("v_b")).alias("delta"),
        F.when(status == "both", pct_diff(F.col("v_a"), F.col("v_b"))).alias("pct"),
        status.alias("status"), "n_a", "n_b",
    )


def overlap_stats(detail: DataFrame, by=()) -> DataFrame:
    """Median, max and exact-equal count of pct, overall or by ``by``.

    The median is exact and comes from a sorted (spillable) histogram, not
    from an in-memory percentile buffer.
    """
    ok = detail.filter(F.col("status") == "both")
    basic = ok.groupBy(*by).agg(F.count("pct").alias("n_pairs"), F.max("pct").alias("max_pct"),
                                F.count_if(F.col("delta") == 0).alias("n_exact"))
    med = exact_median(ok, list(by), "pct", "median_pct")
    if by:
        j = basic.join(med, list(by), "left")
    else:
        j = one_row(basic, med)
    return j.select(*by, "n_pairs", "median_pct", "max_pct", "n_exact")


def one_row(*frames: DataFrame) -> DataFrame:
    """Put one-row aggregates side by side without a join (union + fold)."""
    cols: list[str] = []
    parts = []
    for f in frames:
        cols += [c for c in f.columns if c not in cols]
    for f in frames:
        parts.append(f.select(*[F.col(c) if c in f.columns else F.lit(None).alias(c) for c in cols]))
    u = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return u.agg(*[F.max(c).alias(c) for c in cols])


def splice_verdict(detail: DataFrame, threshold_pct: float) -> DataFrame:
    """One verdict row.

    ``verdict`` is ``accept``, ``abandon`` (median above threshold, or no
    overlap at all) or ``invalid`` (missing or duplicate keys in the overlap).
    ``identical_overlap`` marks a max difference of exactly 0 ("same upstream",
    not independent confirmation).
    """
    both = F.col("status") == "both"
    pct = F.when(both, F.col("pct"))
    thr = F.lit(float(threshold_pct))
    a = detail.agg(
        F.count_if(both).alias("n_pairs"),
        F.count_if(~both).alias("n_missing"),
        F.count_if((F.col("n_a") > 1) | (F.col("n_b") > 1)).alias("n_dup_keys"),
        F.count_if(pct > thr).alias("n_above"),
        F.max(F.when(pct <= thr, pct)).alias("lo_mid"),
        F.min(F.when(pct > thr, pct)).alias("hi_mid"),
        F.max(pct).alias("max_pct"),
        F.count_if(both & (F.col("delta") == 0)).alias("n_exact"),
        median_bracket(pct).alias("__q"),      # exact median, pass 1, in the same aggregate
    )
    n, k = F.col("n_pairs"), F.col("n_above")
    # exact "median > threshold" from counts (see module doc)
    above = (F.when(n % 2 == 1, k * 2 > n)
             .when(k * 2 > n, F.lit(True))
             .when(k * 2 < n, F.lit(False))
             .otherwise((F.col("lo_mid") + F.col("hi_mid")) / 2 > thr))
    verdict = (F.when((F.col("n_missing") > 0) | (F.col("n_dup_keys") > 0), "invalid")
               .when(n == 0, "abandon")
               .when(above, "abandon")
               .otherwise("accept"))
    reason = (F.when(F.col("n_missing") > 0, "missing_keys")
              .when(F.col("n_dup_keys") > 0, "duplicate_keys")
              .when(n == 0, "no_overlap")
              .when(above, "median_above_threshold")
              .otherwise("median_within_threshold"))
    bracket = a.select(F.col("n_pairs").alias("__n"), F.col("__q")[0].alias("__lo"), F.col("__q")[1].alias("__hi"))
    # Both sides have a row wherever both have a value; reading the same columns as above lets both passes share one shuffle.
    values = detail.where(both & (F.col("n_a") > 0) & (F.col("n_b") > 0)).select(F.col("pct").cast("double").alias("__v"))
    a = one_row(a.drop("__q"), median_in_bracket(values, bracket, [], "median_pct"))
    return a.select(
        "n_pairs", "n_missing", "n_dup_keys", "median_pct", "max_pct", "n_exact",
        verdict.alias("verdict"), reason.alias("reason"),
        F.coalesce(F.col("max_pct") == 0, F.lit(False)).alias("identical_overlap"),
    )


def splice(a: DataFrame, b: DataFrame, cutover) -> DataFrame:
    """``b`` before the cutover, ``a`` from it on; never mixed.

    Both filters are on ``ym`` and reach the scans as pushed / partition
    filters; the union is a concatenation (no shuffle).
    """
    early = b.filter(F.col("ym") < F.lit(cutover))
    late = a.filter(F.col("ym") >= F.lit(cutover))
    return early.unionByName(late)


def fallback(a: DataFrame) -> DataFrame:
    """K5: the primary source alone, when the splice is abandoned."""
    return a


def gated_splice(a: DataFrame, b: DataFrame, comparable, cutover, threshold_pct: float):
    """K3→K4/K5: decide (one small action), then return (verdict_row, panel)."""
    v = splice_verdict(overlap_detail(a, b, comparable), threshold_pct).first()
    panel = splice(a, b, cutover) if v["verdict"] == "accept" else fallback(a)
    return v, panel


def shape(panel: DataFrame) -> DataFrame:
    """K7: first / last month, distinct months, rows."""
    return panel.agg(F.min("ym").alias("first_ym"), F.max("ym").alias("last_ym"),
                     F.count_distinct("ym").alias("n_months"), F.count(F.lit(1)).alias("n_rows"))


def provenance_violations(panel: DataFrame, cutover, primary_source: str, secondary_source: str) -> Column:
    """Predicate of a row on the wrong side of the cutover."""
    return (((F.col("ym") >= F.lit(cutover)) & (F.col("source") != primary_source))
            | ((F.col("ym") < F.lit(cutover)) & (F.col("source") != secondary_source)))
