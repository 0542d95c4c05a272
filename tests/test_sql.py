"""The SQL layer over the star schema gives the same results as the DataFrame operators."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from panelforge import spec as S
from panelforge.operators import metrics as M
from panelforge.operators import warehouse as W
from panelforge.operators.normalize import records
from panelforge.operators.splice import splice
from panelforge.plans import sql as Q
from panelforge.sources.csv_strict import strict_csv

from . import fixtures as FX


@pytest.fixture(scope="module")
def star(spark, scratch):
    root = os.path.join(scratch, "sqlstar")
    a = strict_csv(spark, FX.write_live(os.path.join(root, "a.csv")), S.LIVE.columns).rows
    b = strict_csv(spark, FX.write_frozen(os.path.join(root, "b.csv")), S.FROZEN.columns).rows
    W.load_star(spark, os.path.join(root, "wh"), splice(records(a, S.LIVE), records(b, S.FROZEN),
                                                       S.BROADBAND.cutover), S.BROADBAND)
    Q.register_star(spark, os.path.join(root, "wh"))
    return os.path.join(root, "wh")


def test_metrics_sql_equals_dataframe(spark, star):
    fact = W.read_fact(spark, star).select(F.col("year_month").alias("ym"), "tech_code", "accounts")
    df = M.panel_metrics(M.group_levels(fact, S.BROADBAND), S.BROADBAND)
    got = sorted(tuple(r) for r in Q.metrics(spark).collect())
    want = sorted(tuple(r) for r in df.collect())
    assert len(got) == 232 and got == want
    first = [r for r in got if r[0] == "2007-01"][0]
    assert first[5] is None and first[9] is None                   # first net and cum are NULL


def test_snapshot_sql_equals_dataframe(spark, star):
    assert Q.snapshot(spark).first().asDict() == W.snapshot(W.read_fact(spark, star)).first().asDict()


def test_reports_and_bad_rows(spark, star):
    camps = {r.camp: r.rows for r in Q.report_by_camp(spark).collect()}
    assert camps == {"CABLE": 232, "EXCLUDED": 464, "TELCO": 464}
    src = {r.source: (r.rows, r.first_ym, r.last_ym) for r in Q.report_by_source(spark).collect()}
    assert src == {S.SRC_FROZEN: (720, "2007-01", "2018-12"), S.SRC_LIVE: (440, "2019-01", "2026-04")}
    assert Q.bad_rows(spark).first().n_bad == 0
