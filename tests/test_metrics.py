"""Metric semantics and plan shape."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from panelforge.operators import metrics as M
from panelforge.spec import PanelSpec

SPEC = PanelSpec(groups={"x1": "TELCO", "x2": "TELCO", "y": "CABLE", "z": "EXCLUDED"}, primary="TELCO",
                 secondary="CABLE", comparable=("x1", "x2", "y"), cutover=dt.date(2000, 1, 1))


def panel(spark, n=15, hole=None):
    rows = []
    for i in range(n):
        d = dt.date(2000 + i // 12, 1 + i % 12, 1)
        rows += [(d, "x1", 100 + i), (d, "x2", 50 + 2 * i), (d, "z", 7)]
        if i != hole:
            rows.append((d, "y", 60 + 3 * i))
    return spark.createDataFrame(rows, "ym date, tech_code string, accounts long")


def test_levels_nets_ma_cum(spark):
    m = M.panel_metrics(M.group_levels(panel(spark), SPEC), SPEC).orderBy("ym").collect()
    assert len(m) == 15
    first, r11, last = m[0], m[11], m[14]
    assert (first.telco, first.cable, first.total) == (150, 60, 210)
    assert first.telco_net is None and first.telco_cum_net is None           # first row NULL
    assert [r.telco_ma12 for r in m[:11]] == [None] * 11                      # NULL until 12 rows
    assert r11.telco_ma12 == round(sum(150 + 3 * i for i in range(12)) / 12, 1)
    assert last.telco_cum_net == last.telco - first.telco
    assert first.telco_share == round(150 / 210 * 100, 4)


def test_share_uses_exact_decimals(spark):
    df = spark.createDataFrame([(2, 3)], "a long, t long")
    assert df.select(M.share_expr(F.col("a"), F.col("t"))).first()[0] == 66.6667


def test_missing_group_month_keeps_null(spark):
    m = {r.ym: r for r in M.panel_metrics(M.group_levels(panel(spark, hole=5), SPEC), SPEC).collect()}
    r = m["2000-06"]
    assert r.cable is None and r.total is None and r.telco_share is None     # T9: not coalesced
    assert m["2000-07"].cable_net is None


def test_dims_avoid_single_partition(spark):
    p = panel(spark).withColumn("region", F.when(F.col("accounts") > 0, "r1"))
    q = M.panel_metrics(M.group_levels(p, SPEC, dims=["region"]), SPEC, dims=["region"])
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    flat = M.panel_metrics(M.group_levels(panel(spark), SPEC), SPEC)
    assert "SinglePartition" in flat._jdf.queryExecution().executedPlan().toString()
