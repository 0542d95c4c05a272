"""Writer for JSON measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist measurement / result rows as JSON lines (one file per task)."""
    df.write.mode(mode).json(path)
