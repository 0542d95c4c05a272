"""State differences by trees of digests."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from panelforge.operators import hashtree as H

SCHEMA = "k long, t string, v double, x string"
COLS = ["k", "t", "v"]


def made(seed, n):
    r = random.Random(seed)
    return [(r.choice([None, r.randrange(-500, 3000)]) if r.random() < 0.05 else r.randrange(3000),
             r.choice(["a", "b|", None, ""]), r.choice([None, 0.5, 1.0]), "left out") for _ in range(n)]


def brute(a, b):
    ca, cb = (Counter(x[:3] for x in side) for side in (a, b))
    return sorted(((*k, ca[k], cb[k]) for k in ca.keys() | cb.keys() if ca[k] != cb[k]), key=str)


@pytest.mark.parametrize("width, levels", [(1, 4), (64, 2), (10_000, 0)])
def test_diff_equals_brute_force(spark, width, levels):
    a = made(1, 3000)
    b = [x for k, x in enumerate(a) if k % 97] + made(2, 5) + a[:7] + [(None, "a", 1.0, "")]
    da, db = (spark.createDataFrame(x, SCHEMA).repartition(3) for x in (a, b))
    got = sorted((tuple(r) for r in H.state_diff(da, db, "k", width, COLS, levels).collect()), key=str)
    assert got == brute(a, b)


def test_equal_states_and_empty_states(spark):
    a = spark.createDataFrame(made(3, 400), SCHEMA)
    assert H.state_diff(a, a.repartition(5), "k", 16, COLS).count() == 0
    none = a.limit(0)
    assert H.state_diff(none, none, "k", 16, COLS).count() == 0
    assert H.state_diff(a, none, "k", 16, COLS).count() == len({x[:3] for x in made(3, 400)})


def test_many_scattered_ranges_are_found_by_a_join(spark, monkeypatch):
    monkeypatch.setattr(H, "MOST_RANGES", 3)
    a = made(4, 2000)
    b = [(k, t, 9.0 if k is not None and k % 101 == 0 else v, x) for k, t, v, x in a]
    da, db = (spark.createDataFrame(x, SCHEMA) for x in (a, b))
    got = sorted((tuple(r) for r in H.state_diff(da, db, "k", 2, COLS).collect()), key=str)
    assert got == brute(a, b) and got


def test_only_differing_leaves_are_read_by_row(spark, tmp):
    rows = [(k, "t", float(k), "") for k in range(20_000)]
    spark.createDataFrame(rows, SCHEMA).write.option("parquet.block.size", 1 << 14).parquet(f"{tmp}/a")
    a = spark.read.parquet(f"{tmp}/a")
    b = a.withColumn("v", H.F.when(H.F.col("k").between(7000, 7010), 0.0).otherwise(H.F.col("v")))
    trees = [H.build_tree(x, "k", 100, COLS, 3).checkpoint() for x in (a, b)]
    found = H.differing(*trees, 3)
    assert [r[0] for r in found.collect()] == [70]
    diff = H.state_diff(a, b, "k", 100, COLS, trees=tuple(trees))
    assert diff.count() == 22
    plan = diff._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,7000)" in plan and "LessThan(k,7100)" in plan and "Join" not in plan
    read = H.rows_in(a.select(*COLS), "k", 100, found, 1)
    assert read.count() == 100


def test_runs():
    assert H.runs_of([5, 1, 2, 3, 9, 8]) == [(1, 3), (5, 5), (8, 9)]
    assert H.runs_of([]) == []
