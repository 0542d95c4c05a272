"""Command-line steps with the same gates and exit codes as the original scripts.

    python -m panelforge.cli validate --live A.csv --frozen B.csv [--allow-growth]
    python -m panelforge.cli splice   --live A.csv --frozen B.csv
    python -m panelforge.cli load     --live A.csv --frozen B.csv --warehouse W [--verify]
    python -m panelforge.cli metrics  --warehouse W [--check-anchors]
    python -m panelforge.cli refresh  --live A.csv --frozen B.csv --warehouse W [--dry-run] [--no-anchors]

Exit code 0 means the step passed; 1 means a gate stopped it (contract
failure, splice abandoned, load not idempotent, anchors not reproduced). Each
command prints a short report; every heavy step runs on Spark.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import spec as S
from .operators import contracts as C
from .operators import metrics as M
from .operators import splice as K
from .operators import warehouse as W
from .operators.normalize import records
from .session import checkpoint_dir, tune
from .sources.csv_strict import strict_csv
from .streaming.refresh import RefreshConfig, anchor_failures, refresh


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("panelforge").config("spark.ui.enabled", "false").getOrCreate()
    tune(spark)
    checkpoint_dir(spark)
    return spark


def _print_checks(rows) -> None:
    for r in rows:
        print(f"  {'PASS' if r['passed'] else 'FAIL'}  [{r['source']}] {r['check']:<22} {r['detail']}")


def cmd_validate(spark, a) -> int:
    live = strict_csv(spark, a.live, S.LIVE.columns)
    frozen = strict_csv(spark, a.frozen, S.FROZEN.columns)
    checks = C.validate_file(spark, live, S.LIVE, a.allow_growth).unionByName(
        C.validate_file(spark, frozen, S.FROZEN, a.allow_growth))
    rows = checks.collect()
    _print_checks(rows)
    failed = [r for r in rows if not r["passed"]]
    print(f"  {len(rows)} checks, {len(rows) - len(failed)} passed, {len(failed)} failed")
    if live.exists:
        order = C.file_order(live.rows, S.LIVE).first()
        print(f"  live file order: {order['direction']} (diagnostic only)")
    return 1 if failed else 0


def _records(spark, a):
    live = strict_csv(spark, a.live, S.LIVE.columns)
    frozen = strict_csv(spark, a.frozen, S.FROZEN.columns)
    return records(live.rows, S.LIVE), records(frozen.rows, S.FROZEN)


def cmd_splice(spark, a) -> int:
    ra, rb = _records(spark, a)
    detail = K.overlap_detail(ra, rb, S.COMPARABLE)
    for r in K.overlap_stats(detail, ["tech_code"]).orderBy("tech_code").collect():
        print(f"  {r['tech_code']:<12} median {r['median_pct']:.4f}%  max {r['max_pct']:.4f}%  "
              f"equal {r['n_exact']}/{r['n_pairs']}")
    v = K.splice_verdict(detail, S.THRESHOLD_PCT).first()
    print(f"  verdict {v['verdict']} ({v['reason']}); median {v['median_pct']}; max {v['max_pct']}; "
          f"identical overlap: {v['identical_overlap']}")
    if v["verdict"] != "accept":
        return 1
    shape = K.shape(K.splice(ra, rb, S.BROADBAND.cutover)).first()
    print(f"  spliced: {shape['first_ym']} .. {shape['last_ym']}, {shape['n_months']} months, {shape['n_rows']} rows")
    return 0


def cmd_load(spark, a) -> int:
    """Contracts and verdict first: nothing is stored from a file that fails them."""
    live, frozen = strict_csv(spark, a.live, S.LIVE.columns), strict_csv(spark, a.frozen, S.FROZEN.columns)
    try:
        C.gate(C.validate_file(spark, live, S.LIVE, allow_growth=True).unionByName(
            C.validate_file(spark, frozen, S.FROZEN, allow_growth=True)))
    except C.ContractFailed as e:
        _print_checks(e.failed)
        return 1
    ra, rb = records(live.rows, S.LIVE), records(frozen.rows, S.FROZEN)
    verdict = K.splice_verdict(K.overlap_detail(ra, rb, S.COMPARABLE), S.THRESHOLD_PCT).first()
    if verdict["verdict"] != "accept":
        print(f"  verdict {verdict['verdict']} ({verdict['reason']})")
        return 1
    panel = K.splice(ra, rb, S.BROADBAND.cutover)
    if a.verify:
        res = W.verify_idempotent(spark, a.warehouse, panel, S.BROADBAND)
        print(f"  first  {res['first']}\n  second {res['second']}\n  bad rows {res['bad_rows']}")
        return 0 if res["identical"] and res["bad_rows"] == 0 else 1
    W.load_star(spark, a.warehouse, panel, S.BROADBAND)
    print(f"  {W.snapshot(W.read_fact(spark, a.warehouse)).first().asDict()}")
    return 0


def cmd_metrics(spark, a) -> int:
    fact = W.read_fact(spark, a.warehouse).select(F.col("year_month").alias("ym"), "tech_code", "accounts")
    met = M.panel_metrics(M.group_levels(fact, S.BROADBAND), S.BROADBAND)
    for r in met.orderBy(F.col("ym").desc()).limit(3).collect()[::-1]:
        print("  " + "  ".join(f"{k}={v}" for k, v in r.asDict().items()))
    if a.check_anchors:
        cfg = RefreshConfig(S.LIVE, S.FROZEN, S.BROADBAND, a.warehouse, "", anchors=S.GROUND_TRUTH)
        bad = anchor_failures(met, cfg)
        for b in bad:
            print(f"  anchor mismatch: {b}")
        return 1 if bad else 0
    return 0


def cmd_refresh(spark, a) -> int:
    cfg = RefreshConfig(S.LIVE, S.FROZEN, S.BROADBAND, a.warehouse, a.frozen,
                        anchors=None if a.no_anchors else S.GROUND_TRUTH)
    res = refresh(spark, a.live, cfg, dry_run=a.dry_run)
    print(f"  {res}")
    return 0 if res["status"] in ("published", "unchanged", "dry_run") else 1


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="panelforge")
    sub = p.add_subparsers(dest="cmd", required=True)
    for name in ("validate", "splice", "load", "refresh"):
        s = sub.add_parser(name)
        s.add_argument("--live", required=True)
        s.add_argument("--frozen", required=True)
        if name in ("load", "refresh"):
            s.add_argument("--warehouse", required=True)
        if name == "validate":
            s.add_argument("--allow-growth", action="store_true")
        if name == "load":
            s.add_argument("--verify", action="store_true")
        if name == "refresh":
            s.add_argument("--dry-run", action="store_true")
            s.add_argument("--no-anchors", action="store_true")
    m = sub.add_parser("metrics")
    m.add_argument("--warehouse", required=True)
    m.add_argument("--check-anchors", action="store_true")
    a = p.parse_args(argv)
    spark = _session()
    return {"validate": cmd_validate, "splice": cmd_splice, "load": cmd_load,
            "metrics": cmd_metrics, "refresh": cmd_refresh}[a.cmd](spark, a)


if __name__ == "__main__":
    sys.exit(main())
