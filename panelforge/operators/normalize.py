"""Wide text rows → long typed records.

``unpivot`` is a narrow transformation (no shuffle): each wide row becomes one
row per mapped column. Unlisted columns (subtotals, derived totals) are never
selected, so Catalyst prunes them from the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parse import cleaned, parse_reason, strict_int
from ..functions.periods import make_month, roc_split, roc_to_ad
from ..spec import SourceSpec


def period_columns(df: DataFrame, spec: SourceSpec) -> DataFrame:
    """Add ``year``, ``month``, ``ym`` from the spec's period column(s)."""
    if len(spec.period_cols) == 1:
        roc, m = roc_split(F.col(spec.period_cols[0]))
    else:
        y_col, m_col = spec.period_cols
        roc = F.trim(F.col(y_col)).try_cast("int")
        m = F.trim(F.col(m_col)).try_cast("int")
    year = roc_to_ad(roc)
    return (df.withColumn("year", year).withColumn("month", m)
            .withColumn("ym", make_month(F.col("year"), F.col("month"))))


def unpivot_cells(wide: DataFrame, spec: SourceSpec, keep=()) -> DataFrame:
    """One row per (period, mapped column) with the raw text and the code.

    Output: ``year, month, ym, tech_code, raw, source`` (+ ``keep``).
    """
    with_p = period_columns(wide, spec)
    # rename mapped columns to their codes first, so unpivot emits the code itself
    renamed = with_p.select("year", "month", "ym", *keep,
                            *[F.col(f"`{src}`").alias(code) for src, code in spec.unpivot.items()])
    codes = list(spec.unpivot.values())
    long = renamed.unpivot(["year", "month", "ym", *keep], codes, "tech_code", "raw")
    return long.withColumn("source", F.lit(spec.source))


def parse_cells(long: DataFrame) -> DataFrame:
    """typed ``accounts`` plus the rejection ``reason`` (NULL when valid)."""
    c = long.withColumn("_clean", cleaned(F.col("raw")))
    return c.withColumn("accounts", strict_int(F.col("raw"), F.col("_clean"))).withColumn(
        "reason", parse_reason(F.col("raw"), F.col("_clean"))).drop("_clean")


def records(wide: DataFrame, spec: SourceSpec) -> DataFrame:
    """The long record ``(year, month, ym, tech_code, accounts, source)``.

    Callers gate on the contract first; rejected cells stay NULL here.
    """
    return parse_cells(unpivot_cells(wide, spec)).select(
        "year", "month", "ym", "tech_code", "accounts", "source")
