"""Row text encoding and hashing (F16, F17, G11 building blocks).

A row is its fields joined by ``|``; a NULL is written ``\\N``, and a backslash,
``|`` or line feed of a text is written with a backslash before it, so that
different rows never have the same text (nor different lists of rows, joined by
line feeds).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_SENTINEL = "\\N"
SEP = "|"
#: Types whose text holds none of the escaped characters.
PLAIN = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def field_text(c: Column) -> Column:
    out = c.cast("string")
    for special in ("\\", SEP, "\n"):
        out = F.replace(out, F.lit(special), F.lit("\\" + special))
    return out


def row_text(df: DataFrame, cols) -> Column:
    """F16: 'v1|v2|…' of ``cols`` (columns of ``df`` or their names); doubles should be cast to whole units first."""
    cs = [c if isinstance(c, Column) else F.col(c) for c in cols]
    types = [f.dataType for f in df.select(*cs).schema]
    texts = [c.cast("string") if isinstance(t, PLAIN) else field_text(c) for c, t in zip(cs, types, strict=True)]
    return F.array_join(F.array(*texts), SEP, NULL_SENTINEL)


def hash60(text: Column) -> Column:
    """First 15 hex digits of md5 as a non-negative BIGINT (60 bits)."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def whole_sum(h: Column) -> Column:
    """Sum of a BIGINT column as DECIMAL(38,0): 20-bit pieces are summed as longs, which is far cheaper
    than a decimal sum and exact up to 2^39 rows."""
    low = (1 << 20) - 1
    pieces = [(h.bitwiseAND(low), 1), (F.shiftright(h, 20).bitwiseAND(low), 1 << 20), (F.shiftright(h, 40), 1 << 40)]
    out = None
    for piece, unit in pieces:
        part = F.sum(piece).cast("decimal(20,0)") * F.lit(unit).cast("decimal(15,0)")
        out = part if out is None else out + part
    return out.cast("decimal(38,0)")
