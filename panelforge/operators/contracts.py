"""Data contracts as DataFrames of check rows, plus the gate.

A check row is ``(source, check, passed, n_total, n_bad, detail)``.

Scale shape: C3, C4, C5, C6, C7 and C8 are computed in **one** aggregation
over the wide rows (partial aggregates on every task, one tiny merge); the
per-check rows are produced from that single result row by ``inline``. Only
the evidence step (``contract_evidence``) looks at failing rows, and it moves
only those. The gate (C14) is the one action: it collects at most one row
per check.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.parse import (ident, sql_cleaned, sql_has_comma, sql_parse_reason, sql_strict_int,
                               sql_subtotal_class)
from ..functions.periods import span_months, ym_text
from ..sources.csv_strict import StrictScan
from ..spec import TOLERANCE, SourceSpec
from .normalize import period_columns
from ..sources.literal import literal_table

CHECK_SCHEMA = "source string, check string, passed boolean, n_total bigint, n_bad bigint, detail string"


class ContractFailed(RuntimeError):
    def __init__(self, failed: list):
        self.failed = failed
        super().__init__("contract failed: " + ", ".join(f"{r['source']}:{r['check']}" for r in failed))


def _ym(y: int, m: int) -> dt.date:
    return dt.date(y, m, 1)


def _txt(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("NULL"))


def content_checks(wide: DataFrame, spec: SourceSpec, allow_growth: bool = False,
                   tolerance: float = TOLERANCE) -> DataFrame:
    """C3-C8 (+ row width, period parse) in one aggregation pass over ``wide``.

    ``wide`` holds the spec's text columns, optionally ``_width_ok`` from the
    strict CSV scan (T11: short and long records fail the parse check).
    Expressions are written as SQL text: one JVM call per expression.
    """
    growth = bool(allow_growth and spec.live)
    numeric = spec.numeric_cols
    df, v, r = parsed_columns(period_columns(wide, spec), numeric)
    width_ok = "`_width_ok`" if "_width_ok" in wide.columns else "true"
    bad_cells = " + ".join(f"CAST({ident(r[c])} IS NOT NULL AS INT)" for c in numeric)
    comma_row = " OR ".join(sql_has_comma(ident(c)) for c in numeric)
    df = df.selectExpr("ym", f"{bad_cells} AS __bad", f"{comma_row} AS __comma", f"{width_ok} AS __wok",
                       f"{_class_sql(spec, v, tolerance)} AS __cls")
    # one shuffle by month (bounded by the number of periods): per-month
    # partial counts, then a one-row fold. Duplicates and distinct months come
    # from the month groups, so no count(distinct) expansion is needed.
    per = df.groupBy("ym").agg(*[F.expr(e) for e in (
        "count(1) AS n", "coalesce(sum(__bad), 0) AS bad_cells", "count_if(__comma) AS comma_rows",
        "count_if(NOT __wok) AS bad_width", "count_if(__cls = 'exact') AS exact",
        "count_if(__cls = 'within_tolerance') AS within",
        "count_if(__cls IN ('mismatch', 'unparsed')) AS mismatch")])
    a = per.agg(*[F.expr(e) for e in (
        "coalesce(sum(n), 0) AS n", "coalesce(sum(bad_cells), 0) AS bad_cells",
        "coalesce(sum(comma_rows), 0) AS comma_rows", "coalesce(sum(bad_width), 0) AS bad_width",
        "coalesce(sum(CASE WHEN ym IS NULL THEN n END), 0) AS bad_period",
        "coalesce(sum(exact), 0) AS exact", "coalesce(sum(within), 0) AS within",
        "coalesce(sum(mismatch), 0) AS mismatch", "count(ym) AS n_months", "min(ym) AS first",
        "max(ym) AS last")])
    first, last = _ym(*spec.first).isoformat(), _ym(*spec.last).isoformat()
    rows_ok = f"n >= {spec.rows}" if growth else f"n = {spec.rows}"
    last_ok = f"last >= DATE'{last}'" if growth else f"last = DATE'{last}'"
    a = a.selectExpr(
        "*", f"coalesce(CAST(months_between(last, first) + 1 AS INT), 0) AS span",
        f"coalesce(first = DATE'{first}' AND {last_ok}, false) AS range_ok",
        "n - bad_period - n_months AS dup_extra", f"{rows_ok} AS rows_ok")

    def txt(x: str) -> str:
        return f"coalesce(CAST({x} AS STRING), 'NULL')"

    def row(check: str, passed: str, n_total: str, n_bad: str, detail: str) -> str:
        return (f"named_struct('source', '{spec.tag}', 'check', '{check}', 'passed', {passed}, "
                f"'n_total', CAST({n_total} AS BIGINT), 'n_bad', CAST({n_bad} AS BIGINT), "
                f"'detail', CAST({detail} AS STRING))")
    first_txt, last_txt = "date_format(first, 'yyyy-MM')", "date_format(last, 'yyyy-MM')"
    expected = f"' expected{'>=' if growth else '='}{spec.rows}'"
    rows = [
        row("row_count", "rows_ok", "n", f"CASE WHEN rows_ok THEN 0 ELSE abs(n - {spec.rows}) END",
            f"concat('rows=', {txt('n')}, {expected})"),
        row("row_width", "bad_width = 0", "n", "bad_width", f"concat('short_or_long_rows=', {txt('bad_width')})"),
        row("period_parse", "bad_period = 0", "n", "bad_period",
            f"concat('unparsed_periods=', {txt('bad_period')})"),
        row("numerics_parse", "bad_cells = 0", f"n * {len(numeric)}", "bad_cells",
            f"concat('comma_rows=', {txt('comma_rows')})"),
        row("subtotal_arithmetic", "mismatch = 0", "n", "mismatch",
            f"concat('exact=', {txt('exact')}, ';within_tolerance=', {txt('within')}, ';mismatch=', "
            f"{txt('mismatch')})"),
        row("no_duplicate_months", "dup_extra = 0", "n", "dup_extra",
            f"concat('distinct_months=', {txt('n_months')})"),
        row("no_missing_months", "span = n_months", "span", "span - n_months",
            f"concat('span=', {txt('span')}, ';months=', {txt('n_months')})"),
        row("period_range", "range_ok", "1", "CASE WHEN range_ok THEN 0 ELSE 1 END",
            f"concat({txt(first_txt)}, '~', {txt(last_txt)})"),
    ]
    return a.selectExpr(f"inline(array({', '.join(rows)}))")


def parsed_columns(df: DataFrame, cols) -> tuple[DataFrame, dict, dict]:
    """Add cleaned text, value and reject reason per column as plain columns.

    Two projections on purpose: the parsed value and the reason read the
    cleaned text as a column instead of repeating the regex work inside one
    generated expression.
    """
    cl = {c: f"__c{i}" for i, c in enumerate(cols)}
    v = {c: f"__v{i}" for i, c in enumerate(cols)}
    r = {c: f"__r{i}" for i, c in enumerate(cols)}
    out = df.selectExpr("*", *[f"{sql_cleaned(ident(c))} AS {cl[c]}" for c in cols])
    out = out.selectExpr("*", *[f"{sql_strict_int(cl[c])} AS {v[c]}" for c in cols],
                         *[f"{sql_parse_reason(ident(c), cl[c])} AS {r[c]}" for c in cols])
    return out.drop(*cl.values()), v, r


def _class_sql(spec: SourceSpec, v: dict, tolerance: float) -> str:
    if spec.sums is None:
        return "'exact'"
    parts = " + ".join(v[c] for c in spec.sums.parts)
    return sql_subtotal_class(v[spec.sums.total], f"({parts})", tolerance)


def file_checks(spark: SparkSession, scan: StrictScan, spec: SourceSpec) -> tuple[DataFrame, bool]:
    """C1 file exists, C2 ordered header equality (U3 lists missing / extra)."""
    rows = []
    if not scan.exists:
        rows.append((spec.tag, "file_exists", False, 1, 1, f"missing {scan.path}"))
        return literal_table(spark, rows, CHECK_SCHEMA), False
    rows.append((spec.tag, "file_exists", True, 1, 0, scan.path))
    want, got = list(spec.columns), list(scan.header)
    ok = want == got
    missing = [c for c in want if c not in got]
    extra = [c for c in got if c not in want]
    detail = "matches" if ok else f"missing={missing} extra={extra} order_differs={not missing and not extra}"
    rows.append((spec.tag, "column_list", ok, len(want), 0 if ok else max(1, len(missing) + len(extra)), detail))
    return literal_table(spark, rows, CHECK_SCHEMA), ok


def validate_file(spark: SparkSession, scan: StrictScan, spec: SourceSpec,
                  allow_growth: bool = False) -> DataFrame:
    """C1-C8 for one file; a failed C1/C2 skips the content checks."""
    head, ok = file_checks(spark, scan, spec)
    if not ok:
        return head
    return head.unionByName(content_checks(scan.rows, spec, allow_growth))


def gate(checks: DataFrame) -> None:
    """C14: all pass → return; any failure → raise before anything is written."""
    failed = [r.asDict() for r in checks.filter(~F.col("passed")).collect()]
    if failed:
        raise ContractFailed(failed)


# --- keyed-table contracts (C9-C12) ------------------------------------------

def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def month_gaps(df: DataFrame, dims=(), ym: str = "ym") -> DataFrame:
    """Breaks in the sorted distinct months (per dims): after, next, missing count."""
    u = df.select(*dims, F.col(ym).alias("ym")).where(F.col("ym").isNotNull()).distinct()
    w = Window.partitionBy(*dims).orderBy("ym")
    nxt = u.withColumn("next_ym", F.lead("ym").over(w))
    return nxt.where(F.col("next_ym").isNotNull() & (F.col("next_ym") != F.add_months("ym", 1))).select(
        *dims, "ym", "next_ym",
        (span_months(F.col("ym"), F.col("next_ym")) - 2).alias("n_missing"))


def orphan_counts(table, relations) -> DataFrame:
    """Per relation ``(child, child key, parent, parent key)`` the child rows and those without a parent.

    ``table(name, *columns)`` reads a table. Each child table is read once for
    all its relations, and its keys are counted before the join, so a key that
    many rows share is one row of the join. A null key has no parent.
    """
    def side(at: int, key: int) -> DataFrame:
        frames = []
        for name in dict.fromkeys(r[at] for r in relations):
            own = [(i, r[key]) for i, r in enumerate(relations) if r[at] == name]
            pairs = F.array(*[F.struct(F.lit(i).alias("rel"), F.col(c).cast("string").alias("key")) for i, c in own])
            frames.append(table(name, *dict.fromkeys(c for _, c in own)).select(F.inline(pairs)))
        return reduce(DataFrame.unionByName, frames)

    counted = side(0, 1).groupBy("rel", "key").agg(F.count(F.lit(1)).alias("n"))
    parents = side(2, 3).distinct().withColumn("hit", F.lit(True))
    found = counted.join(parents, ["rel", "key"], "left").groupBy("rel").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("hit").isNull(), F.col("n"))), F.lit(0)).alias("bad"))
    names = [F.struct(F.lit(i).alias("rel"), F.lit(f"{c}.{ck}->{p}.{pk}").alias("relation"))
             for i, (c, ck, p, pk) in enumerate(relations)]
    every = table(relations[0][0]).sparkSession.range(1).select(F.inline(F.array(*names)))
    return every.join(found, "rel", "left").select("relation", F.coalesce("n", F.lit(0)).alias("n_child"),
                                                   F.coalesce("bad", F.lit(0)).alias("n_orphans"))


def violation_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One pass, one count per rule (rule = predicate of a violation)."""
    a = df.agg(F.count(F.lit(1)).alias("__n"),
               *[F.count_if(F.coalesce(pred, F.lit(False))).alias(f"__{i}")
                 for i, pred in enumerate(rules.values())])
    items = [F.struct(F.lit(name).alias("rule"), F.col("__n").alias("n_total"),
                      F.col(f"__{i}").alias("n_bad")) for i, name in enumerate(rules)]
    return a.select(F.inline(F.array(*items)))


def not_null_rules(cols) -> dict[str, Column]:
    return {f"{c}_not_null": F.col(c).isNull() for c in cols}


def contract_evidence(wide: DataFrame, spec: SourceSpec, n: int = 3,
                      tolerance: float = TOLERANCE) -> DataFrame:
    """L4: the first ``n`` failing cells / rows per check, ordered by period.

    Only failing rows pass the filter, so the shuffle for ranking carries the
    failures alone, never the table.
    """
    df, v, r = parsed_columns(period_columns(wide, spec), spec.numeric_cols)
    df = df.withColumn("__cls", F.expr(_class_sql(spec, v, tolerance)))
    period_txt = F.coalesce(ym_text(F.col("ym")), F.concat_ws("/", *[F.col(f"`{c}`") for c in spec.period_cols]))
    # every candidate (cell or subtotal) becomes an item; the filter runs after
    # the explode, so it cannot be pushed (and inlined) below the generator
    items = [F.struct(
        F.lit("numerics_parse").alias("check"), F.col(r[c]).isNotNull().alias("bad"),
        F.concat(period_txt, F.lit(" "), F.lit(c), F.lit(": "), _txt(F.col(f"`{c}`")),
                 F.lit(" ("), F.coalesce(F.col(r[c]), F.lit("")), F.lit(")")).alias("evidence"))
        for c in spec.numeric_cols]
    if spec.sums is not None:
        t = F.col(v[spec.sums.total])
        p = reduce(lambda a, b: a + b, [F.col(v[c]) for c in spec.sums.parts])
        cls = F.col("__cls")
        items.append(F.struct(
            F.when(cls == "within_tolerance", F.lit("subtotal_within_tolerance"))
            .otherwise(F.lit("subtotal_arithmetic")).alias("check"),
            cls.isin("mismatch", "unparsed", "within_tolerance").alias("bad"),
            F.concat(period_txt, F.lit(": "), _txt(t), F.lit(" vs "), _txt(p)).alias("evidence")))
    cells = df.select("ym", F.explode(F.array(*items)).alias("it")).where(F.col("it.bad")).select(
        F.col("it.check").alias("check"), "ym", F.col("it.evidence").alias("evidence"))
    parts_all = [cells]
    dups = duplicate_keys(df.where(F.col("ym").isNotNull()), ["ym"]).select(
        F.lit("no_duplicate_months").alias("check"), "ym", ym_text(F.col("ym")).alias("evidence"))
    gaps = month_gaps(df).select(
        F.lit("no_missing_months").alias("check"), "ym",
        F.concat(ym_text(F.col("ym")), F.lit(" -> "), ym_text(F.col("next_ym"))).alias("evidence"))
    allf = reduce(DataFrame.unionByName, parts_all + [dups, gaps])
    w = Window.partitionBy("check").orderBy(F.col("ym").asc_nulls_first(), "evidence")
    return (allf.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
            .select(F.lit(spec.tag).alias("source"), "check", "rank", "evidence"))


def file_order(rows: DataFrame, spec: SourceSpec) -> DataFrame:
    """Physical order of periods in each file — ascending, descending or
    unsorted. Diagnostic only (never a pass / fail input): it relies on the
    ingestion ordinal ``_ord`` of the strict scan, which follows file order.
    """
    df = period_columns(rows, spec)
    w = Window.partitionBy("_file").orderBy("_ord")
    d = df.withColumn("__d", F.datediff(F.col("ym"), F.lag("ym").over(w)))
    g = d.groupBy("_file").agg(F.count_if(F.col("__d") > 0).alias("up"), F.count_if(F.col("__d") < 0).alias("down"),
                               F.count(F.lit(1)).alias("n_rows"))
    direction = (F.when((F.col("down") == 0), "ascending").when(F.col("up") == 0, "descending")
                 .otherwise("unsorted"))
    return g.select(F.lit(spec.tag).alias("source"), "_file", "n_rows", direction.alias("direction"))


def source_invariants(panel: DataFrame, first, dims=()) -> DataFrame:
    """First month fixed, months dense (distinct months == span), per dims.

    For a live source the last month only has to be at or after the previous
    snapshot's, which the caller compares; the frozen source is pinned exactly
    by the period-range contract.
    """
    g = panel.groupBy(*dims).agg(F.min("ym").alias("first_ym"), F.max("ym").alias("last_ym"),
                                 F.count_distinct("ym").alias("n_months"))
    span = span_months(F.col("first_ym"), F.col("last_ym"))
    return g.select(*dims, ym_text(F.col("first_ym")).alias("first_ym"), ym_text(F.col("last_ym")).alias("last_ym"),
                    "n_months", span.alias("span"),
                    (F.col("first_ym") == F.lit(_ym(*first))).alias("first_ok"),
                    (F.col("n_months") == span).alias("dense"))


def comma_periods(rows: DataFrame, spec: SourceSpec) -> DataFrame:
    """P10: the period text of every row where any numeric cell has a separator."""
    any_comma = " OR ".join(sql_has_comma(ident(c)) for c in spec.numeric_cols)
    period = " || '/' || ".join(ident(c) for c in spec.period_cols)
    return rows.where(F.expr(any_comma)).select(F.expr(period).alias("period"))
