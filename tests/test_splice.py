"""Overlap, verdict, splice on the source fixtures."""

from __future__ import annotations

import datetime as dt
import os
import statistics

import pytest
from pyspark.sql import functions as F

from panelforge import spec as S
from panelforge.operators import splice as K
from panelforge.operators.normalize import records
from panelforge.sources.csv_strict import strict_csv

from . import fixtures as FX


@pytest.fixture(scope="module")
def sources(spark, scratch):
    a = strict_csv(spark, FX.write_live(os.path.join(scratch, "splice", "a.csv")), S.LIVE.columns).rows
    b = strict_csv(spark, FX.write_frozen(os.path.join(scratch, "splice", "b.csv")), S.FROZEN.columns).rows
    return records(a, S.LIVE).cache(), records(b, S.FROZEN).cache()


def test_overlap_is_20_periods_and_60_equal_pairs(sources):
    a, b = sources
    p = sorted(r.ym for r in K.overlap_periods(a, b).collect())
    assert len(p) == 20 and p[0] == dt.date(2019, 1, 1) and p[-1] == dt.date(2020, 8, 1)
    d = K.overlap_detail(a, b, S.COMPARABLE)
    assert d.count() == 60 and d.filter("status = 'both' AND pct = 0").count() == 60
    v = K.splice_verdict(d, S.THRESHOLD_PCT).first()
    assert (v.verdict, v.reason, v.identical_overlap, v.n_exact) == ("accept", "median_within_threshold", True, 60)


def test_splice_takes_live_over_the_overlap(sources):
    a, b = sources
    s = K.splice(a, b, S.BROADBAND.cutover)
    assert s.filter(K.provenance_violations(s, S.BROADBAND.cutover, S.SRC_LIVE, S.SRC_FROZEN)).count() == 0
    shape = K.shape(s).first()
    assert (shape.first_ym, shape.last_ym, shape.n_months, shape.n_rows) == \
        (dt.date(2007, 1, 1), dt.date(2026, 4, 1), 232, 1160)   # 232 months x 5 codes


def test_abandon_when_median_above_threshold(sources):
    a, b = sources
    b2 = b.withColumn("accounts", F.col("accounts") + F.ceil(F.col("accounts") * 0.06).cast("bigint"))
    v = K.splice_verdict(K.overlap_detail(a, b2, S.COMPARABLE), S.THRESHOLD_PCT).first()
    assert (v.verdict, v.reason, v.identical_overlap) == ("abandon", "median_above_threshold", False)
    _, panel = K.gated_splice(a, b2, S.COMPARABLE, S.BROADBAND.cutover, S.THRESHOLD_PCT)
    assert panel.agg(F.min("ym")).first()[0] == dt.date(2019, 1, 1)   # K5 fallback: live only


def test_empty_overlap_is_abandon_not_null(sources):
    a, b = sources
    v = K.splice_verdict(K.overlap_detail(a, b.filter("ym < DATE'2010-01-01'"), S.COMPARABLE),
                         S.THRESHOLD_PCT).first()
    assert (v.verdict, v.reason, v.n_pairs) == ("abandon", "no_overlap", 0)


def test_missing_or_duplicate_key_is_invalid(sources):
    a, b = sources
    miss = b.filter(~((F.col("ym") == F.lit(dt.date(2019, 5, 1))) & (F.col("tech_code") == "FTTX")))
    v = K.splice_verdict(K.overlap_detail(a, miss, S.COMPARABLE), S.THRESHOLD_PCT).first()
    assert (v.verdict, v.reason, v.n_missing) == ("invalid", "missing_keys", 1)
    dup = b.unionByName(b.filter((F.col("ym") == F.lit(dt.date(2019, 5, 1))) & (F.col("tech_code") == "ADSL")))
    v = K.splice_verdict(K.overlap_detail(a, dup, S.COMPARABLE), S.THRESHOLD_PCT).first()
    assert (v.verdict, v.reason) == ("invalid", "duplicate_keys")


def test_zero_primary_rule_is_kept(spark):
    mk = lambda rows: spark.createDataFrame(rows, "ym date, tech_code string, accounts long, source string")
    d0 = dt.date(2019, 1, 1)
    a = mk([(d0, "ADSL", 0, "a"), (d0, "FTTX", 0, "a"), (d0, "CABLE_MODEM", 10, "a")])
    b = mk([(d0, "ADSL", 0, "b"), (d0, "FTTX", 4, "b"), (d0, "CABLE_MODEM", 10, "b")])
    got = {r.tech_code: r.pct for r in K.overlap_detail(a, b, S.COMPARABLE).collect()}
    assert got == {"ADSL": 0.0, "FTTX": float("inf"), "CABLE_MODEM": 0.0}   # T15: zero rows kept


@pytest.mark.parametrize("vals", [[1, 2, 4, 8], [1, 5, 9, 2], [6, 4, 5.5, 4.5], [3], [5, 5, 5, 5],
                                  [9, 9, 1, 1, 5.0, 5.0], [float("inf"), 1, 7, 2]])
def test_count_based_verdict_equals_exact_median(spark, vals):
    d0 = dt.date(2019, 1, 1)
    rows = [(dt.date(2019, 1 + i % 12, 1), f"c{i}", float(v), 0, "both", 1, 1) for i, v in enumerate(vals)]
    del d0
    df = spark.createDataFrame(rows, "ym date, tech_code string, pct double, delta long, status string, "
                                     "n_a long, n_b long")
    v = K.splice_verdict(df, 5.0).first()
    med = statistics.median(vals)
    assert v.median_pct == med                                      # T6: exact, interpolated
    assert (v.verdict == "abandon") == (med > 5.0)


def test_unparsed_value_counts_as_missing(spark):
    mk = lambda rows: spark.createDataFrame(rows, "ym date, tech_code string, accounts long, source string")
    d0 = dt.date(2019, 1, 1)
    a = mk([(d0, "ADSL", None, "a"), (d0, "FTTX", 5, "a"), (d0, "CABLE_MODEM", 10, "a")])
    b = mk([(d0, "ADSL", 7, "b"), (d0, "FTTX", 5, "b"), (d0, "CABLE_MODEM", 10, "b")])
    got = {r.tech_code: (r.status, r.pct) for r in K.overlap_detail(a, b, S.COMPARABLE).collect()}
    assert got["ADSL"] == ("missing_a", None)
    assert K.splice_verdict(K.overlap_detail(a, b, S.COMPARABLE), 5.0).first().verdict == "invalid"
