"""The gated refresh, as a batch call and as a stream.

A refresh takes one staged snapshot of the live source (a whole file) and:

1. R1/T13 — compares its latest month with the latest month of the
   *committed fact* (not with a landing file), which is kept beside it with the
   digest of each month. Not newer → success, no change.
2. C1-C8, C13, C14 — validates the staged snapshot (growth mode) and the
   frozen source (strict). Any failure stops the run before any write.
3. K1-K3 — compares the overlap; anything but ``accept`` stops the run.
4. R3 — a dry run stops here.
5. C9-C12/R4/H4 — the months whose digest differs from the committed one are
   read from the fact, no others, and merged as a DataFrame: NOT NULL, CHECK and
   foreign keys, keys that repeat, idempotence (merging the batch again gives
   the same snapshot) and the anchors on metrics, recomputed from the first
   changed month on. Any failure stops the run before any write, so the next run
   meets the same gates again.
6. S7 — merges the rows that are new or changed into the star schema (staged
   merge, touched partitions only) and compares what was written with the
   checked frame; then brings the kept digests and metrics up to date.
   ``loaded_at`` is the time a row last changed. After an interrupted commit, or
   where nothing is kept yet, both come from the whole fact again.

Every step appends a ledger row. Because the staged data is validated as a
DataFrame before anything is written, no backup / restore is needed (S13). A
run that began its commit and did not publish (a lost driver) is not taken for
"unchanged": the next run goes through although the fact may hold the month.

R8 runs the same function from ``foreachBatch`` over a landing folder, one
file per micro-batch (``maxFilesPerTrigger=1``, honoured by ``availableNow``),
since each file is a whole snapshot. The stream's checkpoint lies in the
warehouse by default, so a restart processes new files only. A replayed batch
is harmless: the merge is idempotent, and each run has an id of its own.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.periods import ym_text
from ..operators import contracts as C
from ..operators import incremental as I
from ..operators import metrics as M
from ..operators import splice as K
from ..operators import warehouse as W
from ..operators.normalize import records
from ..session import checkpoint_dir
from ..sources import ledger
from ..sources.fs import delete, exists
from ..sources.csv_strict import CORRUPT, StrictScan, read_header, strict_csv, text_schema, with_scan_columns
from ..spec import PanelSpec, SourceSpec


@dataclass
class RefreshConfig:
    live: SourceSpec
    frozen: SourceSpec
    panel: PanelSpec
    warehouse: str
    frozen_path: str
    partition: str = "year"
    verify_idempotence: bool = True
    anchors: dict | None = None        # {'yyyy-MM': {primary: n, secondary: n, 'share': x}}
    share_tolerance: float = 0.005

    @property
    def ledger_path(self) -> str:
        return os.path.join(self.warehouse, "_ledger")

    @property
    def states_path(self) -> str:
        return os.path.join(self.warehouse, "_month_states")

    @property
    def metrics_path(self) -> str:
        return os.path.join(self.warehouse, "metrics_monthly")


def committed_latest(spark: SparkSession, warehouse: str):
    if not exists(spark, os.path.join(warehouse, "fact_subscriptions_monthly")):
        return None
    return W.read_fact(spark, warehouse).agg(F.max("year_month")).first()[0]


def interrupted(spark: SparkSession, cfg: RefreshConfig) -> bool:
    """Whether the last run that began a commit did not publish it."""
    runs = ledger.read(spark, cfg.ledger_path).groupBy("run_id").agg(
        F.max(F.when(F.col("step") == "commit", F.col("ts"))).alias("began"),
        F.max((F.col("step") == "done") & (F.col("status") == "published")).alias("published"))
    last = runs.where("began IS NOT NULL").agg(F.max_by("published", "began").alias("published")).first()
    return last["published"] is False


def kept_states(spark: SparkSession, cfg: RefreshConfig) -> tuple[DataFrame | None, bool]:
    """Month states of the committed fact (None without one), and whether they had to come from all of it."""
    if not exists(spark, os.path.join(cfg.warehouse, "fact_subscriptions_monthly")):
        return None, False
    if not exists(spark, cfg.states_path) or interrupted(spark, cfg):
        return W.month_states(W.read_fact(spark, cfg.warehouse)), True
    return spark.read.parquet(cfg.states_path).drop("year"), False


def fact_of(spark: SparkSession, cfg: RefreshConfig, months: list) -> DataFrame:
    """The committed rows of ``months``; only their partitions are read."""
    values = sorted({m.year if cfg.partition == "year" else f"{m:%Y-%m}" for m in months})
    return W.read_fact(spark, cfg.warehouse).where(F.col(cfg.partition).isin(values) & F.col("year_month").isin(months))


def checked_metrics(spark: SparkSession, merged: DataFrame, cfg: RefreshConfig, whole: bool) -> DataFrame:
    """The metric table as it would be after the commit, ``merged`` being the changed months (all if ``whole``)."""
    levels = M.group_levels(merged.select(F.col("year_month").alias("ym"), "tech_code", "accounts"), cfg.panel)
    if whole:
        return M.panel_metrics(levels, cfg.panel)
    kept = spark.read.parquet(cfg.metrics_path).drop("year")
    tail = M.metrics_tail(kept, levels, cfg.panel)
    out = kept.join(tail.select("ym"), "ym", "left_anti").unionByName(tail)
    return out.withColumn("ym", ym_text(F.col("ym")))


def _failed_detail(checks: DataFrame) -> str:
    rows = checks.filter(~F.col("passed")).select("source", "check", "detail").collect()
    return "; ".join(f"{r['source']}:{r['check']} ({r['detail']})" for r in rows)


def refresh_rows(spark: SparkSession, staged_rows: DataFrame, staged_header: list, cfg: RefreshConfig,
                 dry_run: bool = False, run_id: str | None = None) -> dict:
    """Gated refresh for already-scanned staged rows (see module doc)."""
    run_id = run_id or uuid.uuid4().hex[:12]

    def log(step: str, status: str, detail: str = "") -> None:
        ledger.append(spark, cfg.ledger_path, run_id, step, status, detail)

    staged_rows = staged_rows.cache()
    spliced = checks = merged = None
    try:
        # 1. latest-period gate against the committed fact
        from ..operators.normalize import period_columns
        new_latest = period_columns(staged_rows, cfg.live).agg(F.max("ym")).first()[0]
        states, rebuild = kept_states(spark, cfg)
        cur_latest = states.agg(F.max("year_month")).first()[0] if states is not None else None
        log("latest_period", "ok", f"committed={cur_latest} staged={new_latest}")
        seen = cur_latest is not None and new_latest is not None and new_latest <= cur_latest
        if new_latest is None or (seen and not (rebuild and interrupted(spark, cfg))):
            log("done", "unchanged", "no new period")
            return {"run_id": run_id, "status": "unchanged", "committed": cur_latest, "staged": new_latest}

        # 2. contracts: staged live (growth mode) + frozen (strict)
        staged_scan = StrictScan("<staged>", True, list(staged_header), staged_rows)
        live_checks = C.validate_file(spark, staged_scan, cfg.live, allow_growth=True)
        frozen_scan = strict_csv(spark, cfg.frozen_path, cfg.frozen.columns)
        frozen_checks = C.validate_file(spark, frozen_scan, cfg.frozen, allow_growth=True)
        checks = live_checks.unionByName(frozen_checks).cache()
        failed = checks.filter(~F.col("passed")).count()
        if failed:
            detail = _failed_detail(checks)
            log("contracts", "failed", detail)
            return {"run_id": run_id, "status": "failed", "step": "contracts", "detail": detail}
        log("contracts", "ok", f"{checks.count()} checks passed")

        # 3. overlap verdict
        a = records(staged_rows, cfg.live)
        b = records(frozen_scan.rows, cfg.frozen)
        verdict = K.splice_verdict(K.overlap_detail(a, b, cfg.panel.comparable), cfg.panel.threshold_pct).first()
        if verdict["verdict"] != "accept":
            log("splice", "failed", f"{verdict['verdict']}:{verdict['reason']}")
            return {"run_id": run_id, "status": "failed", "step": "splice", "verdict": verdict.asDict()}
        log("splice", "ok", f"median={verdict['median_pct']} identical={verdict['identical_overlap']}")

        # 4. dry run
        if dry_run:
            log("done", "dry_run", "validated only, nothing written")
            return {"run_id": run_id, "status": "dry_run", "verdict": verdict.asDict()}

        # 5. the merged fact must pass every check before anything is written
        spliced = K.splice(a, b, cfg.panel.cutover).cache()
        try:
            W.check_fact(spliced, cfg.panel)
        except W.BadRecords as e:
            log("load", "failed", str(e))
            return {"run_id": run_id, "status": "failed", "step": "load", "detail": str(e)}
        batch = W.fact_rows(spliced)
        new_states = W.month_states(batch)
        if states is None:
            differ = new_states
        else:
            differ = new_states.join(states.select("year_month", "n", "h"), ["year_month", "n", "h"], "left_anti")
        months = [r[0] for r in differ.select("year_month").collect()]     # one for each month of the calendar at most
        batch = batch.where(F.col("year_month").isin(months))
        old = batch.limit(0) if states is None else fact_of(spark, cfg, months).select(*batch.columns)
        same = [F.col(f"n.{c}").eqNullSafe(F.col(f"o.{c}")) for c in W.FACT_COLS]
        changed = batch.alias("n").join(old.alias("o"), same, "left_anti")
        merged = W.merge_frames(old, batch, W.FACT_KEY).cache()
        repeated = C.duplicate_keys(merged, W.FACT_KEY).count()
        nbad = W.bad_rows(merged).first()["n_bad"]
        if repeated or nbad:
            log("load", "failed", f"repeated keys={repeated} bad rows={nbad}")
            return {"run_id": run_id, "status": "failed", "step": "load"}

        def folded(part: DataFrame) -> dict:
            """Snapshot of the fact with the states ``part`` in place of those of the changed months."""
            rest = [] if states is None else [states.where(~F.col("year_month").isin(months))]
            return W.fold_months(reduce(DataFrame.unionByName, rest, part)).first().asDict()

        snap = folded(W.month_states(merged))
        if cfg.verify_idempotence:
            again = folded(W.month_states(W.merge_frames(merged, batch, W.FACT_KEY)))
            if again != snap:
                log("load", "failed", f"not idempotent: {snap} vs {again}")
                return {"run_id": run_id, "status": "failed", "step": "load"}
        whole = states is None or rebuild or not exists(spark, cfg.metrics_path)
        if cfg.anchors:
            fact = merged
            if whole and states is not None:
                fact = W.merge_frames(W.read_fact(spark, cfg.warehouse).select(*batch.columns), batch, W.FACT_KEY)
            bad = anchor_failures(checked_metrics(spark, fact, cfg, whole), cfg)
            if bad:
                log("metrics", "failed", "; ".join(bad))
                return {"run_id": run_id, "status": "failed", "step": "metrics", "detail": bad}
            log("metrics", "ok", f"{len(cfg.anchors)} anchors")

        # 6. commit the rows that differ, compare, and bring what is kept beside the fact up to date
        log("commit", "started", f"{cur_latest} -> {new_latest}")
        W.load_star(spark, cfg.warehouse, changed.withColumnRenamed("year_month", "ym"), cfg.panel, cfg.partition)
        if rebuild or states is None:
            now = W.month_states(W.read_fact(spark, cfg.warehouse))
            stored = W.fold_months(now).first().asDict()
        else:
            now = W.month_states(fact_of(spark, cfg, months))
            stored = folded(now)
        if stored != snap:
            log("load", "failed", f"stored {stored} is not {snap}")
            return {"run_id": run_id, "status": "failed", "step": "load"}
        W.upsert(spark, cfg.states_path, now.withColumn("year", F.year("year_month")), ["year_month"], "year",
                 check_unique=False, moves=False)
        if whole and exists(spark, cfg.metrics_path):
            delete(spark, cfg.metrics_path)
        part = F.year("year_month") if cfg.partition == "year" else ym_text(F.col("year_month"))
        I.maintain_metrics(spark, cfg.metrics_path, W.read_fact(spark, cfg.warehouse),
                           batch.withColumn(cfg.partition, part), cfg.panel, partition_by=cfg.partition)
        log("load", "ok", f"rows={snap['n_rows']} md5={snap['md5']}")

        log("done", "published", f"{cur_latest} -> {new_latest}")
        return {"run_id": run_id, "status": "published", "snapshot": snap,
                "committed": cur_latest, "staged": new_latest}
    finally:
        for kept in (staged_rows, spliced, checks, merged):
            if kept is not None:
                kept.unpersist()


def anchor_failures(met: DataFrame, cfg: RefreshConfig) -> list[str]:
    """H4: exact levels and share within tolerance for every anchor month."""
    p, s = cfg.panel.p, cfg.panel.s
    rows = {r["ym"]: r for r in met.filter(F.col("ym").isin(*cfg.anchors)).collect()}
    out = []
    for ym, want in cfg.anchors.items():
        got = rows.get(ym)
        if got is None:
            out.append(f"{ym}: missing")
            continue
        if got[p] != want[p] or got[s] != want[s]:
            out.append(f"{ym}: levels {got[p]},{got[s]} != {want[p]},{want[s]}")
        if got[f"{p}_share"] is None or abs(got[f"{p}_share"] - want["share"]) >= cfg.share_tolerance:
            out.append(f"{ym}: share {got[f'{p}_share']} != {want['share']}")
    return out


def refresh(spark: SparkSession, staged_path: str, cfg: RefreshConfig, dry_run: bool = False,
            run_id: str | None = None) -> dict:
    """Batch refresh from one staged snapshot file."""
    scan = strict_csv(spark, staged_path, cfg.live.columns)
    if not scan.exists:
        rid = run_id or uuid.uuid4().hex[:12]
        ledger.append(spark, cfg.ledger_path, rid, "contracts", "failed", f"missing {staged_path}")
        return {"run_id": rid, "status": "failed", "step": "contracts"}
    return refresh_rows(spark, scan.rows, scan.header, cfg, dry_run, run_id)


def landing_stream(spark: SparkSession, landing: str, cfg: RefreshConfig, checkpoint: str | None = None,
                   dry_run: bool = False):
    """Process every snapshot dropped into ``landing`` once, in arrival order.

    Returns the started query (``trigger(availableNow=True)``); call
    ``awaitTermination()`` on it. ``checkpoint`` is a folder of the warehouse
    that only depends on ``landing``, unless given.
    """
    checkpoint_dir(spark)
    folder = hashlib.md5(landing.rstrip("/").encode()).hexdigest()[:12]
    checkpoint = checkpoint or os.path.join(cfg.warehouse, "_streams", f"landing-{folder}")
    schema = text_schema(cfg.live.columns).add(CORRUPT, "string")
    stream = (spark.readStream.schema(schema).option("header", "true").option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", CORRUPT).option("encoding", "UTF-8")
              .option("maxFilesPerTrigger", 1).csv(landing))

    def on_batch(df: DataFrame, batch_id: int) -> None:
        rows = df.withColumn("__file", F.input_file_name())
        files = [r[0] for r in rows.select("__file").distinct().collect()]   # one file per batch
        for f in sorted(files):
            staged = with_scan_columns(rows.filter(F.col("__file") == f).drop("__file"))
            refresh_rows(spark, staged, read_header(spark, f), cfg, dry_run,
                         run_id=f"batch-{batch_id}-{uuid.uuid4().hex[:8]}")

    return (stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


__all__ = ["RefreshConfig", "refresh", "refresh_rows", "landing_stream", "committed_latest"]
