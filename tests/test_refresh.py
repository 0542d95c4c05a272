"""Gated refresh in batch and streaming form."""

from __future__ import annotations

import os

from panelforge import spec as S
from panelforge.operators import warehouse as W
from panelforge.sources import ledger
from panelforge.streaming.refresh import RefreshConfig, landing_stream, refresh

from . import fixtures as FX


def cfg(tmp, frozen):
    return RefreshConfig(live=S.LIVE, frozen=S.FROZEN, panel=S.BROADBAND, warehouse=os.path.join(tmp, "wh"),
                         frozen_path=frozen, verify_idempotence=True)


def test_refresh_gates(spark, tmp):
    frozen = FX.write_frozen(os.path.join(tmp, "src", "b.csv"))
    c = cfg(tmp, frozen)
    first = FX.write_live(os.path.join(tmp, "in", "a1.csv"))
    # dry run: validates, writes nothing
    assert refresh(spark, first, c, dry_run=True)["status"] == "dry_run"
    assert not os.path.exists(os.path.join(c.warehouse, "fact_subscriptions_monthly"))
    # real run publishes
    res = refresh(spark, first, c)
    assert res["status"] == "published" and res["snapshot"]["n_rows"] == 1160
    # same snapshot again: no new period, nothing to do (current comes from the fact, T13)
    assert refresh(spark, first, c)["status"] == "unchanged"
    # a new month with a broken cell: contracts stop it before any write
    rows = [FX.live_row(2026, 5)] + FX.live_rows()
    rows[0][1] = "12a"
    bad = FX.write_live(os.path.join(tmp, "in", "a2.csv"), rows=rows)
    out = refresh(spark, bad, c)
    assert out["status"] == "failed" and out["step"] == "contracts" and "numerics_parse" in out["detail"]
    assert W.read_fact(spark, c.warehouse).count() == 1160
    # the clean new month goes through (growth mode)
    good = FX.write_live(os.path.join(tmp, "in", "a3.csv"), rows=[FX.live_row(2026, 5)] + FX.live_rows())
    res = refresh(spark, good, c)
    assert res["status"] == "published" and res["snapshot"]["max_ym"] == "2026-05"
    steps = ledger.read(spark, c.ledger_path).collect()
    assert {r.status for r in steps if r.step == "done"} >= {"dry_run", "published", "unchanged"}


def test_landing_stream_processes_each_snapshot_once(spark, tmp):
    frozen = FX.write_frozen(os.path.join(tmp, "src", "b.csv"))
    c = cfg(tmp, frozen)
    land = os.path.join(tmp, "landing")
    os.makedirs(land)
    FX.write_live(os.path.join(land, "snap-2026-04.csv"))
    FX.write_live(os.path.join(land, "snap-2026-05.csv"), rows=[FX.live_row(2026, 5)] + FX.live_rows())
    q = landing_stream(spark, land, c, checkpoint=os.path.join(tmp, "ckpt"))
    q.awaitTermination(300)
    fact = W.read_fact(spark, c.warehouse)
    assert fact.count() == 1165
    done = [r for r in ledger.read(spark, c.ledger_path).collect() if r.step == "done"]
    assert sorted(r.status for r in done) == ["published", "published"]
    # restart on the same checkpoint: nothing is reprocessed
    q = landing_stream(spark, land, c, checkpoint=os.path.join(tmp, "ckpt"))
    q.awaitTermination(300)
    assert len([r for r in ledger.read(spark, c.ledger_path).collect() if r.step == "done"]) == 2


def test_anchor_self_check(spark, tmp):
    frozen = FX.write_frozen(os.path.join(tmp, "src", "b.csv"))
    v = {c: FX.value(2019, 1, c) for c in S.CAMP}
    telco, cable = v["ADSL"] + v["FTTX"], v["CABLE_MODEM"]
    good = {"2019-01": {"telco": telco, "cable": cable, "share": round(telco / (telco + cable) * 100, 2)}}
    c = cfg(tmp, frozen)
    c.anchors, c.verify_idempotence = good, False
    live = FX.write_live(os.path.join(tmp, "in", "a.csv"))
    assert refresh(spark, live, c)["status"] == "published"
    bad = cfg(os.path.join(tmp, "other"), frozen)
    bad.anchors = {"2019-01": {**good["2019-01"], "telco": telco + 1}}
    out = refresh(spark, live, bad)
    assert out["status"] == "failed" and out["step"] == "metrics" and len(out["detail"]) == 1
    # nothing was written, so the next try meets the same gate
    assert not os.path.exists(os.path.join(bad.warehouse, "fact_subscriptions_monthly"))
    assert refresh(spark, live, bad)["status"] == "failed"


def test_an_interrupted_commit_is_not_unchanged(spark, tmp):
    c = cfg(tmp, FX.write_frozen(os.path.join(tmp, "src", "b.csv")))
    live = FX.write_live(os.path.join(tmp, "in", "a.csv"))
    assert refresh(spark, live, c, run_id="first")["status"] == "published"
    ledger.append(spark, c.ledger_path, "lost", "commit", "started")
    assert refresh(spark, live, c, run_id="again")["status"] == "published"
    assert refresh(spark, live, c)["status"] == "unchanged"


def test_landing_stream_keeps_its_place_on_default_settings(spark, tmp):
    c = cfg(tmp, FX.write_frozen(os.path.join(tmp, "src", "b.csv")))
    land = os.path.join(tmp, "landing")
    os.makedirs(land)
    FX.write_live(os.path.join(land, "snap-2026-04.csv"))
    landing_stream(spark, land, c).awaitTermination(300)
    before = {tuple(r) for r in ledger.read(spark, c.ledger_path).collect()}
    landing_stream(spark, land, c).awaitTermination(300)
    assert {tuple(r) for r in ledger.read(spark, c.ledger_path).collect()} == before and before
    FX.write_live(os.path.join(land, "snap-2026-05.csv"), rows=[FX.live_row(2026, 5)] + FX.live_rows())
    landing_stream(spark, land, c).awaitTermination(300)
    done = [r for r in ledger.read(spark, c.ledger_path).collect() if r.step == "done"]
    assert sorted(r.status for r in done) == ["published", "published"]


def test_missing_staged_file_fails_at_contracts(spark, tmp):
    frozen = FX.write_frozen(os.path.join(tmp, "src", "b.csv"))
    out = refresh(spark, os.path.join(tmp, "in", "nope.csv"), cfg(tmp, frozen))
    assert out["status"] == "failed" and out["step"] == "contracts"
