"""Text → number rules, as Column expressions (JVM-side, no UDFs).

One parser only: the strict contract parser. A cell is valid when, after
removing thousands commas and trimming Unicode whitespace, it is one or more
ASCII digits that fit a BIGINT. Signs, decimals, underscores, full-width digits
and blanks are rejected with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# reason codes written next to every rejected cell
BLANK = "blank"
NOT_DIGITS = "not_digits"
OVERFLOW = "overflow"


def cleaned(raw: Column) -> Column:
    """strip thousands commas, then trim Unicode whitespace (incl. U+3000)."""
    return F.regexp_replace(F.regexp_replace(raw, ",", ""), r"(?U)^\s+|\s+$", "")


def parse_reason(raw: Column, clean: Column | None = None) -> Column:
    """NULL when the cell is a valid non-negative integer, else the reason.

    Pass ``clean`` (a column already holding ``cleaned(raw)``) after an
    unpivot or explode: it keeps the cleaned text a plain column reference
    instead of a repeated sub-expression in the generated code.
    """
    c = cleaned(raw) if clean is None else clean
    return (
        F.when(raw.isNull() | (c == ""), F.lit(BLANK))
        .when(~c.rlike("^[0-9]+$"), F.lit(NOT_DIGITS))
        .when(_over_bigint(c), F.lit(OVERFLOW))
    )


_BIGINT_MAX = "9223372036854775807"


def _over_bigint(digits: Column) -> Column:
    """A digit string above BIGINT range, decided on text (no cast inside CASE)."""
    d = F.regexp_replace(digits, "^0+(?=[0-9])", "")
    n = F.length(d)
    return (n > len(_BIGINT_MAX)) | ((n == len(_BIGINT_MAX)) & (d > F.lit(_BIGINT_MAX)))


def strict_int(raw: Column, clean: Column | None = None) -> Column:
    """BIGINT value of a valid cell, NULL for any rejected cell."""
    c = cleaned(raw) if clean is None else clean
    return F.when(c.rlike("^[0-9]+$") & ~_over_bigint(c), c.cast("bigint"))


def has_comma(raw: Column) -> Column:
    """P10: the cell carries a thousands separator."""
    return F.coalesce(F.contains(raw, F.lit(",")), F.lit(False))


def pct_diff(primary: Column, other: Column) -> Column:
    """|a-b|/a*100 with the zero rule (a=0: 0 if equal, else +inf).

    The guard comes first, so ANSI mode never sees a division by zero.
    """
    a, b = primary.cast("double"), other.cast("double")
    return (
        F.when(a != 0, F.abs(a - b) / a * 100)
        .when(a == b, F.lit(0.0))
        .otherwise(F.lit(float("inf")))
    )


def subtotal_class(total: Column, parts: Column, tolerance: float) -> Column:
    """C5/F14: 'exact', 'within_tolerance' (passes, counted) or 'mismatch'.

    ``total = 0`` with non-zero parts is a mismatch; a NULL side is 'unparsed'.
    """
    t, p = total.cast("decimal(38,0)"), parts.cast("decimal(38,0)")
    return (
        F.when(t.isNull() | p.isNull(), F.lit("unparsed"))
        .when(t == p, F.lit("exact"))
        .when((t != 0) & (F.abs(t - p) / F.abs(t) <= F.lit(tolerance)), F.lit("within_tolerance"))
        .otherwise(F.lit("mismatch"))
    )


def thousands(x: Column) -> Column:
    """integer with thousands separators ("1,234,567")."""
    return F.format_number(x, 0)


# --- the same rules as Spark SQL expression text -------------------------------
# Used where many columns are parsed at once (contracts): one expression string
# per column is one call into the JVM instead of one per expression node. The
# rules are identical to the Column versions above (tests check both).

def ident(name: str) -> str:
    """A column name as a quoted SQL identifier."""
    return "`" + name.replace("`", "``") + "`"


def sql_cleaned(x: str) -> str:
    return r"regexp_replace(regexp_replace(" + x + r", ',', ''), '(?U)^\\s+|\\s+$', '')"


def sql_over_bigint(c: str) -> str:
    d = f"regexp_replace({c}, '^0+(?=[0-9])', '')"
    n = len(_BIGINT_MAX)
    return f"(length({d}) > {n} OR (length({d}) = {n} AND {d} > '{_BIGINT_MAX}'))"


def sql_strict_int(c: str) -> str:
    """``c`` holds cleaned text."""
    return f"CASE WHEN {c} RLIKE '^[0-9]+$' AND NOT {sql_over_bigint(c)} THEN CAST({c} AS BIGINT) END"


def sql_parse_reason(raw: str, c: str) -> str:
    """``raw`` is the cell, ``c`` its cleaned text."""
    return (f"CASE WHEN {raw} IS NULL OR {c} = '' THEN '{BLANK}' "
            f"WHEN NOT ({c} RLIKE '^[0-9]+$') THEN '{NOT_DIGITS}' "
            f"WHEN {sql_over_bigint(c)} THEN '{OVERFLOW}' END")


def sql_has_comma(raw: str) -> str:
    return f"coalesce(contains({raw}, ','), false)"


def sql_subtotal_class(total: str, parts: str, tolerance: float) -> str:
    t, p = f"CAST({total} AS DECIMAL(38,0))", f"CAST({parts} AS DECIMAL(38,0))"
    return (f"CASE WHEN {t} IS NULL OR {p} IS NULL THEN 'unparsed' WHEN {t} = {p} THEN 'exact' "
            f"WHEN {t} <> 0 AND abs({t} - {p}) / abs({t}) <= CAST({float(tolerance)!r} AS DOUBLE) "
            f"THEN 'within_tolerance' ELSE 'mismatch' END")
