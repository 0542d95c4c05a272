"""Month arithmetic as Column expressions.

A period is always a DATE on the first of the month. Timestamps in the driver
tables are TIMESTAMP_NTZ; ``trunc`` of a DATE keeps a DATE (``date_trunc``
would hand back a session-zone TIMESTAMP), so months are built from
``to_date`` + ``trunc``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import ROC_OFFSET


def month_of(ts: Column) -> Column:
    """First day of the month of a date / timestamp."""
    return F.trunc(F.to_date(ts), "MM")


def roc_split(period_text: Column) -> tuple[Column, Column]:
    """'ROC/month' → (roc year, month) as INTs; NULL when malformed."""
    parts = F.split(period_text, "/")
    ok = F.size(parts) == 2
    y = F.when(ok, F.trim(parts.getItem(0)).try_cast("int"))
    m = F.when(ok, F.trim(parts.getItem(1)).try_cast("int"))
    return y, m


def roc_to_ad(roc_year: Column) -> Column:
    """Gregorian year = ROC year + 1911."""
    return roc_year + F.lit(ROC_OFFSET)


def ad_to_roc(year: Column) -> Column:
    return year - F.lit(ROC_OFFSET)


def make_month(year: Column, month: Column) -> Column:
    """make_date(y, m, 1); NULL (not an error) for month outside 1..12."""
    return F.when(month.between(1, 12) & year.between(1, 9999), F.make_date(year, month, F.lit(1)))


def ym_text(d: Column) -> Column:
    """zero-padded 'yyyy-MM'."""
    return F.date_format(d, "yyyy-MM")


def parse_ym(text: Column) -> Column:
    """F8: 'yyyy-MM' → first-of-month DATE."""
    return F.to_date(text, "yyyy-MM")


def next_month(d: Column) -> Column:
    """successor month with year carry."""
    return F.add_months(d, 1)


def span_months(first: Column, last: Column) -> Column:
    """inclusive count of months between two first-of-month dates."""
    return (F.months_between(F.trunc(last, "MM"), F.trunc(first, "MM")) + 1).cast("int")


def years_between(first: Column, last: Column) -> Column:
    """whole years between two months, rounded half-even like Python round()."""
    months = (F.year(last) - F.year(first)) * 12 + (F.month(last) - F.month(first))
    return F.bround(months.cast("decimal(10,0)") / F.lit(12), 0).cast("int")
