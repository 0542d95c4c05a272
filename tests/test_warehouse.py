"""Merge protocol, idempotence, fingerprints."""

from __future__ import annotations

import datetime as dt
import glob
import os

import pytest
from pyspark.sql import functions as F

from panelforge import spec as S
from panelforge.operators import fingerprint as FP
from panelforge.operators import warehouse as W
from panelforge.operators.normalize import records
from panelforge.operators.splice import splice
from panelforge.sources.csv_strict import strict_csv

from . import fixtures as FX


@pytest.fixture(scope="module")
def spliced(spark, scratch):
    a = strict_csv(spark, FX.write_live(os.path.join(scratch, "wh", "a.csv")), S.LIVE.columns).rows
    b = strict_csv(spark, FX.write_frozen(os.path.join(scratch, "wh", "b.csv")), S.FROZEN.columns).rows
    return splice(records(a, S.LIVE), records(b, S.FROZEN), S.BROADBAND.cutover).cache()


def test_load_twice_is_idempotent(spark, tmp, spliced):
    res = W.verify_idempotent(spark, tmp, spliced, S.BROADBAND)
    assert res["identical"] and res["bad_rows"] == 0
    snap = res["first"]
    assert (snap["n_rows"], snap["min_ym"], snap["max_ym"], snap["n_tech"]) == (1160, "2007-01", "2026-04", 5)
    dims = spark.read.parquet(os.path.join(tmp, "dim_period"))
    assert dims.count() == 232 and dims.filter("quarter < 1 OR quarter > 4 OR month < 1 OR month > 12").count() == 0


def test_merge_updates_touched_partitions_only_and_never_deletes(spark, tmp, spliced):
    W.load_star(spark, tmp, spliced, S.BROADBAND)
    part = os.path.join(tmp, "fact_subscriptions_monthly")
    before = {p: os.path.getmtime(p) for p in glob.glob(os.path.join(part, "year=*", "*.parquet"))}
    batch = spliced.filter(F.col("ym") == F.lit(dt.date(2026, 4, 1))).filter("tech_code <> 'PWLAN'") \
        .withColumn("accounts", F.col("accounts") + 1)
    touched = W.load_star(spark, tmp, batch, S.BROADBAND)["touched"]
    assert touched == [2026]
    after = {p: os.path.getmtime(p) for p in glob.glob(os.path.join(part, "year=*", "*.parquet"))}
    untouched = [p for p in before if "year=2026" not in p]
    assert all(after.get(p) == before[p] for p in untouched)          # other years not rewritten
    f = W.read_fact(spark, tmp)
    assert f.count() == 1160                                           # PWLAN 2026-04 kept (no delete)
    apr = {r.tech_code: r.accounts for r in f.filter(F.col("year_month") == F.lit(dt.date(2026, 4, 1))).collect()}
    base = {r.tech_code: r.accounts for r in spliced.filter(F.col("ym") == F.lit(dt.date(2026, 4, 1))).collect()}
    assert all(apr[c] == base[c] + (0 if c == "PWLAN" else 1) for c in base)


def test_duplicate_batch_keys_rejected(spark, tmp, spliced):
    dup = spliced.unionByName(spliced.limit(1))
    with pytest.raises(W.DuplicateBatchKeys):
        W.load_star(spark, tmp, dup, S.BROADBAND)


def test_merge_policies(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "k long, v string")
    upd = sorted(tuple(r) for r in W.merge_frames(old, new, ["k"], "update").collect())
    ign = sorted(tuple(r) for r in W.merge_frames(old, new, ["k"], "ignore").collect())
    assert upd == [(1, "a"), (2, "B"), (3, "C")] and ign == [(1, "a"), (2, "b"), (3, "C")]


def test_fingerprints_see_row_content_not_just_sums(spark):
    a = spark.createDataFrame([(1, "x", 10), (2, "y", 20)], "m long, c string, v long")
    b = spark.createDataFrame([(1, "x", 20), (2, "y", 10)], "m long, c string, v long")   # same count and sum
    fa = FP.ordered_fingerprint(a, "m", ["m", "c"], ["m", "c", "v"]).first()
    fb = FP.ordered_fingerprint(b, "m", ["m", "c"], ["m", "c", "v"]).first()
    assert fa.fingerprint != fb.fingerprint
    ua, ub = FP.unordered_fingerprint(a, ["m", "c", "v"]).first(), FP.unordered_fingerprint(b, ["m", "c", "v"]).first()
    assert ua.hash_sum != ub.hash_sum
    shuffled = FP.unordered_fingerprint(a.repartition(7), ["m", "c", "v"]).first()
    assert shuffled.hash_sum == ua.hash_sum                           # order-insensitive
    n1 = spark.createDataFrame([("a", None, "b")], "x string, y string, z string")
    n2 = spark.createDataFrame([("a", "b", None)], "x string, y string, z string")
    assert FP.unordered_fingerprint(n1, ["x", "y", "z"]).first().hash_sum != \
        FP.unordered_fingerprint(n2, ["x", "y", "z"]).first().hash_sum   # T7: no concat_ws collision
    eq = FP.states_equal(FP.unordered_fingerprint(a, ["m"]), FP.unordered_fingerprint(a, ["m"])).first()
    assert eq.identical


def test_unordered_snapshot_detects_changes(spark, spliced):
    from panelforge.operators.fingerprint import states_equal
    f = W.fact_rows(spliced)
    a = W.snapshot(f, ordered=False)
    b = W.snapshot(f.withColumn("accounts", F.when(F.col("tech_code") == "ADSL", F.col("accounts") + 1)
                                .otherwise(F.col("accounts") - 1)), ordered=False)
    eq = states_equal(a, b).first()
    assert eq.same_n_rows and eq.same_n_tech and not eq.same_md5 and not eq.identical
    assert W.snapshot(f, ordered=False).first().n_rows == 1160


def test_xxhash_fingerprint(spark):
    a = spark.createDataFrame([(1, "x", 10), (2, "y", 20)], "m long, c string, v long")
    b = spark.createDataFrame([(1, "x", 20), (2, "y", 10)], "m long, c string, v long")
    fa = FP.unordered_fingerprint(a, ["m", "c", "v"], "xxhash64").first().hash_sum
    assert fa != FP.unordered_fingerprint(b, ["m", "c", "v"], "xxhash64").first().hash_sum
    assert fa == FP.unordered_fingerprint(a.repartition(5), ["m", "c", "v"], "xxhash64").first().hash_sum
    n1 = spark.createDataFrame([("a", None, "b")], "x string, y string, z string")
    n2 = spark.createDataFrame([("a", "b", None)], "x string, y string, z string")
    assert FP.unordered_fingerprint(n1, ["x", "y", "z"], "xxhash64").first().hash_sum != \
        FP.unordered_fingerprint(n2, ["x", "y", "z"], "xxhash64").first().hash_sum


def _merged(spark, path, first, second, schema, **more):
    W.upsert(spark, path, spark.createDataFrame(first, schema), ["k"], "p", **more)
    W.upsert(spark, path, spark.createDataFrame(second, schema), ["k"], "p", **more)
    return sorted((r.k, r.p, r.v) for r in spark.read.schema(schema).parquet(path).collect())


def test_upsert_refuses_null_partition_and_keeps_the_table(spark, tmp):
    path = tmp + "/t"
    W.upsert(spark, path, spark.createDataFrame([(1, "a", 1)], "k int, p string, v int"), ["k"], "p")
    for bad in [(2, None, 2)], [(None, "a", 2)]:
        with pytest.raises(W.NullBatchKeys):
            W.upsert(spark, path, spark.createDataFrame(bad, "k int, p string, v int"), ["k"], "p")
    assert [tuple(r) for r in spark.read.parquet(path).select("k", "p", "v").collect()] == [(1, "a", 1)]


def test_upsert_keeps_the_partition_type(spark, tmp):
    got = _merged(spark, tmp + "/t", [(1, "01", 1), (2, "01", 2)], [(1, "01", 9)], "k int, p string, v int")
    assert got == [(1, "01", 9), (2, "01", 2)]


def test_upsert_of_a_key_that_moves(spark, tmp):
    got = _merged(spark, tmp + "/t", [(1, 2020, 1), (2, 2020, 2), (3, 2019, 3)], [(1, 2021, 9), (3, 2021, 8)], "k int, p int, v int")
    assert got == [(1, 2021, 9), (2, 2020, 2), (3, 2021, 8)]


def test_upsert_leaves_no_staging(spark, tmp):
    import glob

    from panelforge.session import checkpoint_dir
    before = set(glob.glob(checkpoint_dir(spark).removeprefix("file://") + "/staging-*"))
    _merged(spark, tmp + "/t", [(1, 1, 1)], [(1, 1, 2)], "k int, p int, v int")
    assert set(glob.glob(checkpoint_dir(spark).removeprefix("file://") + "/staging-*")) == before


def test_load_refuses_records_that_break_the_schema(spark, tmp):
    import datetime as dt
    schema = "ym date, tech_code string, accounts bigint, source string"
    for row in [(dt.date(2020, 1, 1), "ADSL", None, "x"), (None, "ADSL", 1, "x"), (dt.date(2020, 1, 1), "NOPE", 1, "x"),
                (dt.date(2020, 1, 1), "ADSL", -1, "x")]:
        with pytest.raises(W.BadRecords):
            W.load_star(spark, tmp + "/wh", spark.createDataFrame([row], schema), S.BROADBAND)


def test_row_text_tells_rows_apart(spark):
    def mark(*row):
        return FP.unordered_fingerprint(spark.createDataFrame([row], "x string, y string"), ["x", "y"], "md5").first().hash_sum
    rows = [("a|", "b"), ("a", "|b"), ("\\N", "b"), (None, "b"), ("a\\", "b"), ("a\\|", "b"), ("a\n", "b")]
    assert len({mark(*r) for r in rows}) == len(rows)
