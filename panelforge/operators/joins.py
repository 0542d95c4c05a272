"""Broadcast only behind a size check.

``bounded_broadcast`` takes the number of rows the caller *knows* the side has
(a spec's literal list, or a count it just ran) and marks the side for
broadcast only under ``limit`` rows; otherwise the join is left to Catalyst
and AQE, which shuffle it or convert it at run time from measured sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROW_LIMIT = 1_000_000


def bounded_broadcast(df: DataFrame, known_rows: int, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    return F.broadcast(df) if 0 <= known_rows <= limit else df
