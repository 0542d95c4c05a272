"""R5, G5/T4, G13, W4-at-scale, W7, U5, S12, T16: scale operators against brute force."""

from __future__ import annotations

import datetime as dt
import os
import random
import statistics

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge import spec as S
from panelforge.functions.periods import month_of
from panelforge.operators import contracts as C
from panelforge.operators import fingerprint as FP
from panelforge.operators import scale as X
from panelforge.sources.csv_strict import strict_csv

from . import fixtures as FX


@pytest.mark.parametrize("block", [1, 7, 64, 10_000])
def test_blocked_cumsum_equals_global_window(spark, block):
    rnd = random.Random(block)
    rows = [(k, None if rnd.random() < 0.1 else rnd.randint(-50, 500)) for k in rnd.sample(range(5000), 900)]
    rows[0] = (min(r[0] for r in rows) - 1, None)             # leading NULL keeps the sum NULL
    df = spark.createDataFrame(rows, "k long, v long")
    got = {r.k: r.c for r in X.blocked_cumsum(df, "k", "v", "c", block).collect()}
    want = {r.k: r.c for r in df.select("k", F.sum("v").over(Window.orderBy("k")).alias("c")).collect()}
    assert got == want


def test_blocked_cumsum_per_dim_has_no_single_partition(spark):
    df = spark.createDataFrame([(i % 3, i, i) for i in range(100)], "g long, k long, v long")
    out = X.blocked_cumsum(df, "k", "v", "c", 8, dims=["g"])
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    want = {(r.g, r.k): r.c for r in df.select("g", "k", F.sum("v").over(
        Window.partitionBy("g").orderBy("k")).alias("c")).collect()}
    assert {(r.g, r.k): r.c for r in out.collect()} == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exact_median_matches_statistics(spark, seed):
    rnd = random.Random(seed)
    rows = [(rnd.choice("abc"), float(rnd.randint(0, 40)) / 4) for _ in range(rnd.randint(1, 400))]
    rows += [("hot", 2.5)] * 300 + [("hot", 7.0)] * 299                  # one hot group
    got = {r.g: r.median for r in X.exact_median(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    for g in got:
        assert got[g] == statistics.median([v for k, v in rows if k == g])


def test_rollup_rounds_average_half_up(spark):
    df = spark.createDataFrame([("r", 1), ("r", 2), ("s", 1), ("s", 1), ("s", 3)], "g string, v long")
    got = {r.g: (r.total, r.avg_accounts) for r in X.rollup(df, "g", "v").collect()}
    assert got == {"r": (3, 2), "s": (5, 2)}    # 1.5 -> 2 and 1.67 -> 2 (a cast would give 1, 1)


def test_scale_table_formula_and_size(spark):
    periods = spark.createDataFrame([(dt.date(2019, 1, 1),), (dt.date(2019, 2, 1),)], "year_month date")
    codes = spark.createDataFrame([("FTTX",), ("ADSL",)], "tech_code string")
    t = X.scale_table(spark, periods, codes, 3, 4, 2, 2)
    rows = t.collect()
    assert len(rows) == 2 * 2 * 3 * 4 and len({(r.year_month, r.tech_code, r.region_code, r.operator_id)
                                                for r in rows}) == len(rows)
    r = [x for x in rows if x.year_month == dt.date(2019, 2, 1) and x.tech_code == "FTTX"
         and x.region_code == "R03" and x.operator_id == 4][0]
    epoch = (dt.date(2019, 2, 1) - dt.date(1970, 1, 1)).days
    assert r.accounts == (epoch * 7 + 3 * 131 + 4 * 17 + 4 * 991) % 500000


def test_file_order_diagnostic(spark, tmp):
    a = strict_csv(spark, FX.write_live(os.path.join(tmp, "a.csv")), S.LIVE.columns).rows
    b = strict_csv(spark, FX.write_frozen(os.path.join(tmp, "b.csv")), S.FROZEN.columns).rows
    assert C.file_order(a, S.LIVE).first().direction == "descending"
    assert C.file_order(b, S.FROZEN).first().direction == "ascending"


def test_row_diff_is_a_multiset_difference(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([(1, "x"), (3, "z")], "k long, v string")
    got = sorted(tuple(r) for r in FP.row_diff(a, b, ["k", "v"]).collect())
    assert got == [(1, "x", "only_in_a"), (2, "y", "only_in_a"), (3, "z", "only_in_b")]


def test_catalog_metadata_json_path(spark):
    doc = '{"result": {"title": "t", "modifiedDate": "2026-05-01", "distribution": ' \
          '[{"resourceDownloadUrl": "https://example.invalid/a.csv"}, {"resourceDownloadUrl": "b"}]}}'
    df = spark.createDataFrame([(doc,)], "j string")
    r = df.select(F.get_json_object("j", "$.result.distribution[0].resourceDownloadUrl").alias("u"),
                  F.get_json_object("j", "$.result.title").alias("t")).first()
    assert (r.u, r.t) == ("https://example.invalid/a.csv", "t")


def test_month_of_ntz_timestamp_is_a_date(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2026-03-18 23:30:00' AS ts")
    out = df.select(month_of(F.col("ts")).alias("m"))
    assert dict(out.dtypes)["m"] == "date" and out.first().m == dt.date(2026, 3, 1)   # T16


def test_exact_median_hot_group_continuous_values(spark):
    rnd = random.Random(7)
    hot = [("hot", rnd.random() * 1000) for _ in range(30_000)] + [("hot", 500.0)] * 5_000
    rows = hot + [("small", float(x)) for x in (1, 2)] + [("inf", float("inf")), ("inf", 1.0), ("inf", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r.median for r in X.exact_median(df, ["g"], "v").collect()}
    for g in got:
        assert got[g] == statistics.median([v for k, v in rows if k == g])
    whole = X.exact_median(df.select("v"), [], "v").collect()
    assert len(whole) == 1 and whole[0].median == statistics.median([v for _, v in rows])
    empty = X.exact_median(df.where("v < 0").select("v"), [], "v").collect()
    assert len(empty) == 1 and empty[0].median is None


def test_scale_conf_sizes_partitions():
    from panelforge.session import scale_conf
    big = scale_conf(100 * (1 << 40), 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 819200        # 100 TB / 128 MB
    small = scale_conf(10 << 20, 8)
    assert int(small["spark.sql.shuffle.partitions"]) == 24          # 3 waves of 8 cores


def test_a_bracket_that_misses_the_middle_raises(spark):
    v = spark.createDataFrame([("g", float(x)) for x in range(9)], "g string, __v double")
    n = "g string, __n long, __lo double, __hi double"
    good = X.median_in_bracket(v, spark.createDataFrame([("g", 9, 3.0, 5.0)], n), ["g"]).collect()
    assert good[0].median == 4.0
    for lo, hi in ((5.0, 8.0), (0.0, 3.0)):
        with pytest.raises(Exception, match="bracket"):
            X.median_in_bracket(v, spark.createDataFrame([("g", 9, lo, hi)], n), ["g"]).collect()


def test_blocked_cumsum_over_several_super_blocks(spark, monkeypatch):
    monkeypatch.setattr(X, "SUPER", 3)
    rows = [(i, None if i < 7 or i % 5 == 0 else i) for i in range(60)]
    got = {r.k: r.c for r in X.blocked_cumsum(spark.createDataFrame(rows, "k long, v long"), "k", "v", "c", 4).collect()}
    total, want = None, {}
    for k, x in rows:
        total = total if x is None else (total or 0) + x
        want[k] = total
    assert got == want
