"""G5 R6 S7 M7 incrementally: signed changes, rollups and metrics that follow a fact; what a refresh reads."""

from __future__ import annotations

import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from panelforge import spec as S
from panelforge.operators import incremental as I
from panelforge.operators import metrics as M
from panelforge.operators import warehouse as W

FACT = "k int, region string, year int, v long"
KEYS = ["k", "year"]


def rows(spark, data):
    return spark.createDataFrame(data, FACT)


def scratch_rows(seed, n, years=(2001, 2002, 2003)):
    r = random.Random(seed)
    return [(k, r.choice("abc"), years[k % len(years)], r.choice([None, r.randrange(100)])) for k in r.sample(range(60), n)]


def state(df, cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


def rolled(data):
    out: dict = {}
    for _, region, year, v in data:
        n, s = out.get((region, year), (0, 0))
        out[region, year] = (n + 1, s + (v or 0))
    return sorted(((*k, *x) for k, x in out.items()), key=str)


@pytest.fixture()
def rollup(tmp):
    return I.Rollup(os.path.join(tmp, "rollup"), ("region", "year"), ("v",), "year")


def test_signed_changes_add_up_to_the_merge(spark):
    old, new = rows(spark, [(1, "a", 1, 5), (2, "a", 1, 6), (3, None, 1, None)]), [(2, "b", 1, 6), (3, None, 1, None), (4, "c", 1, 1)]
    got = I.signed_changes(old, rows(spark, new), KEYS)
    assert state(got, [*old.columns, "sign"]) == sorted([(2, "a", 1, 6, -1), (2, "b", 1, 6, 1), (4, "c", 1, 1, 1)], key=str)
    assert state(I.signed_changes(old, rows(spark, new), KEYS, "ignore"), ["k", "sign"]) == [(4, 1)]
    assert I.signed_changes(old, rows(spark, new), KEYS, compare=["v"]).count() == 1


@pytest.mark.parametrize("policy", ["update", "ignore"])
def test_rollup_follows_many_batches(spark, tmp, rollup, policy):
    path, held = os.path.join(tmp, "fact"), {}
    for seq in range(1, 5):
        batch = scratch_rows(seq, 25)
        I.merge_and_maintain(spark, path, rows(spark, batch), KEYS, "year", [rollup], seq, policy)
        for x in batch:
            if policy == "update" or (x[0], x[2]) not in held:
                held[x[0], x[2]] = x
        assert state(I.read_rollup(spark, rollup), ["region", "year", "n", "v"]) == rolled(held.values())
    assert state(spark.read.parquet(path), ["k", "region", "year", "v"]) == sorted(held.values(), key=str)
    assert sorted(os.listdir(f"{path}_changes")) == ["seq=4"]


def test_replays_and_lost_runs_count_once(spark, tmp, rollup, monkeypatch):
    path, first, second = os.path.join(tmp, "fact"), scratch_rows(1, 30), scratch_rows(2, 30)
    merge = lambda data, seq: I.merge_and_maintain(spark, path, rows(spark, data), KEYS, "year", [rollup], seq)
    merge(first, 1)
    real = I.apply_delta
    monkeypatch.setattr(I, "apply_delta", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):       # lost after the fact was merged, before the rollup
        merge(second, 2)
    monkeypatch.setattr(I, "apply_delta", real)
    merge(second, 2)
    merge(second, 2)
    held = {(x[0], x[2]): x for x in [*first, *second]}
    want = rolled(held.values())
    assert state(I.read_rollup(spark, rollup), ["region", "year", "n", "v"]) == want
    assert merge(first, 1).count() == 0     # an older batch that comes again changes nothing
    assert state(I.read_rollup(spark, rollup), ["region", "year", "n", "v"]) == want


def test_a_rollup_half_written_is_completed(spark, rollup):
    delta = spark.createDataFrame([("a", 2001, 2, 7), ("a", 2002, 1, 3)], "region string, year int, n long, v long")
    I.apply_delta(spark, rollup, delta.where("year = 2001"), 5)      # lost before the second partition
    assert I.apply_delta(spark, rollup, delta, 5) == [2002]
    assert state(I.read_rollup(spark, rollup), ["region", "year", "n", "v"]) == [("a", 2001, 2, 7), ("a", 2002, 1, 3)]


def test_only_touched_partitions_are_read_and_written(spark, tmp, rollup):
    path = os.path.join(tmp, "fact")
    I.merge_and_maintain(spark, path, rows(spark, scratch_rows(1, 40)), KEYS, "year", [rollup], 1)
    before = {p: os.path.getmtime(p) for root in (path, rollup.path) for p in glob.glob(f"{root}/year=*/*.parquet")}
    I.merge_and_maintain(spark, path, rows(spark, [(1, "a", 2002, 1000)]), KEYS, "year", [rollup], 2)
    after = {p: os.path.getmtime(p) for root in (path, rollup.path) for p in glob.glob(f"{root}/year=*/*.parquet")}
    assert all(after.get(p) == t for p, t in before.items() if "year=2002" not in p)
    assert not any("year=2002" in p and after.get(p) == t for p, t in before.items())
    near = I.touched_groups(spark, rollup, spark.read.parquet(rollup.path).schema, [2002])
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "(year" in plan and "= 2002)" in plan


def test_more_rows_leaving_than_there_are_is_an_error(spark, rollup):
    delta = spark.createDataFrame([("a", 2001, -1, 0)], "region string, year int, n long, v long")
    with pytest.raises(Exception, match="more rows leave"):
        I.apply_delta(spark, rollup, delta, 1)


def _levels(spark, data):
    p, s = S.BROADBAND.p, S.BROADBAND.s
    df = spark.createDataFrame(data, f"g string, ym date, {p} long, {s} long")
    return df.withColumn("total", F.col(p) + F.col(s))


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("dims", [["g"], []])
def test_metrics_tail_equals_the_whole(spark, seed, dims):
    r = random.Random(seed)
    months = [dt.date(2000 + k // 12, k % 12 + 1, 1) for k in range(40)]
    value = lambda: r.choice([None, r.randrange(1000)]) if seed % 2 else r.randrange(1000)
    held = {(g, m): (g, m, value(), value()) for g in ("xyz" if dims else "x") for m in months if r.random() < 0.85}
    start = {k: v for k, v in held.items() if k[1] < months[30]}
    change = {k: v for k, v in held.items() if k[1] >= months[30] and k[0] != "z"}
    change |= {k: (*k, value(), value()) for k in r.sample(sorted(start), 3) if k[0] != "z"}
    change |= {(g, months[r.randrange(25)]): None for g in "y" if dims}
    change = {k: v or (*k, value(), value()) for k, v in change.items()}
    first = M.panel_metrics(_levels(spark, list(start.values())), S.BROADBAND, dims, ym_as_text=False)
    final = M.panel_metrics(_levels(spark, list({**start, **change}.values())), S.BROADBAND, dims, ym_as_text=False)
    tail = M.metrics_tail(first, _levels(spark, list(change.values())), S.BROADBAND, dims)
    kept = first.join(tail.select(*dims, "ym"), [*dims, "ym"], "left_anti").unionByName(tail)
    assert state(kept, final.columns) == state(final, final.columns)
    firsts = {}
    for g, m in change:
        firsts[g if dims else ""] = min(m, firsts.get(g if dims else "", m))
    want = sum(m >= firsts.get(g if dims else "", dt.date.max) for g, m in {**start, **change})
    assert tail.count() == want


def test_metrics_tail_without_changes_is_empty(spark):
    levels = _levels(spark, [("x", dt.date(2000, 1, 1), 1, 2)])
    first = M.panel_metrics(levels, S.BROADBAND, ym_as_text=False)
    assert M.metrics_tail(first, levels.limit(0), S.BROADBAND).count() == 0


def test_snapshot_folds_from_kept_months(spark):
    data = [(dt.date(2000, m, 1), c, m * 10, "s") for m in range(1, 5) for c in ("A", "B")]
    fact = spark.createDataFrame(data, "year_month date, tech_code string, accounts long, source string")
    parts = [W.month_states(fact.where(F.month("year_month") == m)) for m in range(1, 5)]
    one = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    assert W.fold_months(one).first() == W.snapshot(fact).first()
