"""C1-C16 on hand-built source files: all pass on good input, each fails on its negative."""

from __future__ import annotations

import os

import pytest

from panelforge import spec as S
from panelforge.operators import contracts as C
from panelforge.sources.csv_strict import strict_csv

from . import fixtures as FX


def checks(spark, path, spec, growth=False):
    scan = strict_csv(spark, path, spec.columns)
    rows = C.validate_file(spark, scan, spec, allow_growth=growth).collect()
    return {r["check"]: r for r in rows}


def failed(res):
    return sorted(k for k, r in res.items() if not r["passed"])


def test_good_sources_pass_all_16(spark, tmp):
    live = checks(spark, FX.write_live(os.path.join(tmp, "a.csv")), S.LIVE)
    frozen = checks(spark, FX.write_frozen(os.path.join(tmp, "b.csv")), S.FROZEN)
    assert failed(live) == [] and failed(frozen) == []
    core = ["file_exists", "column_list", "row_count", "numerics_parse", "subtotal_arithmetic",
            "no_duplicate_months", "no_missing_months", "period_range"]
    assert all(k in live and k in frozen for k in core)       # 8 checks x 2 sources
    assert live["numerics_parse"]["detail"] == "comma_rows=2"   # only ROC 109/1 and 109/2
    assert live["row_count"]["n_total"] == 88 and frozen["row_count"]["n_total"] == 164


def test_missing_file_is_a_failed_check(spark, tmp):
    res = checks(spark, os.path.join(tmp, "nope.csv"), S.LIVE)
    assert failed(res) == ["file_exists"] and len(res) == 1


@pytest.mark.parametrize("header", [
    [S.COLS_LIVE[1], S.COLS_LIVE[0], *S.COLS_LIVE[2:]],      # reordered
    S.COLS_LIVE[:-1],                                        # missing column
    [*S.COLS_LIVE, "extra"],                                 # extra column
])
def test_header_must_match_in_order(spark, tmp, header):
    rows = [r[:len(header)] + [""] * (len(header) - len(r)) for r in FX.live_rows()]
    res = checks(spark, FX.write_live(os.path.join(tmp, "a.csv"), rows=rows, header=header), S.LIVE)
    assert failed(res) == ["column_list"] and "row_count" not in res


def test_row_count_and_growth_only_for_live(spark, tmp):
    short = FX.live_rows()[1:]   # drops the newest month
    res = checks(spark, FX.write_live(os.path.join(tmp, "a.csv"), rows=short), S.LIVE)
    assert "row_count" in failed(res) and "period_range" in failed(res)
    grown = [FX.live_row(2026, 5)] + FX.live_rows()
    p = FX.write_live(os.path.join(tmp, "g.csv"), rows=grown)
    assert failed(checks(spark, p, S.LIVE, growth=False)) == ["period_range", "row_count"]
    assert failed(checks(spark, p, S.LIVE, growth=True)) == []
    fgrown = FX.frozen_rows() + [FX.frozen_row(2020, 9)]
    pf = FX.write_frozen(os.path.join(tmp, "fg.csv"), rows=fgrown)
    assert failed(checks(spark, pf, S.FROZEN, growth=True)) == ["period_range", "row_count"]


@pytest.mark.parametrize("bad", ["", "-5", "1.5", "12a", "1_000", "１２３", "12345678901234567890"])
def test_bad_cells_fail_numerics(spark, tmp, bad):
    rows = FX.live_rows()
    rows[3][2] = bad
    res = checks(spark, FX.write_live(os.path.join(tmp, "a.csv"), rows=rows), S.LIVE)
    assert "numerics_parse" in failed(res)
    assert res["numerics_parse"]["n_bad"] == 1
    assert "subtotal_arithmetic" in failed(res)   # T12: reported, not a crash


def test_short_and_long_records(spark, tmp):
    rows = FX.live_rows()
    p = FX.write_live(os.path.join(tmp, "a.csv"), rows=rows[:-2],
                      raw_lines=[",".join(rows[-2][:5]), ",".join(rows[-1] + ["9"])])
    res = checks(spark, p, S.LIVE)
    assert res["row_width"]["n_bad"] == 2 and "row_width" in failed(res)


def _with_total(rows, i, factor):
    rows = [list(r) for r in rows]
    t = int(rows[i][-1].replace(",", ""))
    rows[i][-1] = str(round(t * factor))
    return rows


def test_subtotal_tolerance_passes_but_is_counted(spark, tmp):
    res = checks(spark, FX.write_frozen(os.path.join(tmp, "b.csv"), rows=_with_total(FX.frozen_rows(), 5, 1.0005)),
                 S.FROZEN)
    assert failed(res) == []
    assert res["subtotal_arithmetic"]["detail"] == "exact=163;within_tolerance=1;mismatch=0"
    res = checks(spark, FX.write_frozen(os.path.join(tmp, "c.csv"), rows=_with_total(FX.frozen_rows(), 5, 1.01)),
                 S.FROZEN)
    assert failed(res) == ["subtotal_arithmetic"]


def test_total_zero_with_parts_is_a_mismatch(spark, tmp):
    rows = FX.frozen_rows()
    rows[7][-1] = "0"
    res = checks(spark, FX.write_frozen(os.path.join(tmp, "b.csv"), rows=rows), S.FROZEN)
    assert failed(res) == ["subtotal_arithmetic"]


def test_duplicate_and_missing_months(spark, tmp):
    rows = FX.frozen_rows()
    dup = rows[:20] + [rows[19]] + rows[20:]
    res = checks(spark, FX.write_frozen(os.path.join(tmp, "d.csv"), rows=dup), S.FROZEN)
    assert "no_duplicate_months" in failed(res) and res["no_duplicate_months"]["n_bad"] == 1
    gap = [r for r in rows if not (r[0] == "97" and r[1] == "1")]   # 2008-01 missing across a year end
    res = checks(spark, FX.write_frozen(os.path.join(tmp, "e.csv"), rows=gap), S.FROZEN)
    assert "no_missing_months" in failed(res) and res["no_missing_months"]["n_bad"] == 1
    ev = C.contract_evidence(FX_wide(spark, os.path.join(tmp, "e.csv")), S.FROZEN).collect()
    assert [r.evidence for r in ev if r.check == "no_missing_months"] == ["2007-12 -> 2008-02"]


def FX_wide(spark, path):
    return strict_csv(spark, path, S.FROZEN.columns).rows


def test_first_month_earlier_or_last_regressed(spark, tmp):
    early = FX.frozen_rows(first=(2006, 12))
    res = checks(spark, FX.write_frozen(os.path.join(tmp, "b.csv"), rows=early), S.FROZEN)
    assert "period_range" in failed(res)
    regressed = FX.live_rows(last=(2026, 3))
    res = checks(spark, FX.write_live(os.path.join(tmp, "a.csv"), rows=regressed), S.LIVE, growth=True)
    assert "period_range" in failed(res)


def test_gate_raises_before_any_write(spark, tmp):
    rows = FX.live_rows()
    rows[0][1] = "x"
    scan = strict_csv(spark, FX.write_live(os.path.join(tmp, "a.csv"), rows=rows), S.LIVE.columns)
    with pytest.raises(C.ContractFailed):
        C.gate(C.validate_file(spark, scan, S.LIVE))


def test_keyed_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, c string")
    assert [tuple(r) for r in C.duplicate_keys(df, ["k", "c"]).collect()] == [(1, "a", 2)]
    parent = spark.createDataFrame([(1,)], "k long")
    tables = {"child": df.unionByName(spark.createDataFrame([(None, "z")], df.schema)), "parent": parent}
    got = C.orphan_counts(lambda t, *cols: tables[t].select(*cols) if cols else tables[t],
                          [("child", "k", "parent", "k"), ("parent", "k", "child", "k")]).collect()
    assert {tuple(r) for r in got} == {("child.k->parent.k", 4, 2), ("parent.k->child.k", 1, 0)}
    v = {r.rule: r.n_bad for r in C.violation_counts(df, {"k_le_1": df.k > 1, **C.not_null_rules(["c"])}).collect()}
    assert v == {"k_le_1": 1, "c_not_null": 0}


def test_comma_rows_are_exactly_the_two_known_ones(spark, tmp):
    scan = strict_csv(spark, FX.write_live(os.path.join(tmp, "a.csv")), S.LIVE.columns)
    assert {r.period for r in C.comma_periods(scan.rows, S.LIVE).collect()} == {"109/1", "109/2"}


def test_header_only_file_fails_with_reasons_not_a_crash(spark, tmp):
    res = checks(spark, FX.write_frozen(os.path.join(tmp, "b.csv"), rows=[]), S.FROZEN)
    assert {"row_count", "period_range"} <= set(failed(res))          # T12
    assert res["row_count"]["n_total"] == 0 and res["period_range"]["detail"] == "NULL~NULL"
