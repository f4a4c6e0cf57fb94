"""Eager checks of columns; they cost no job."""

from __future__ import annotations

from pyspark.sql import DataFrame


def require_columns(df: DataFrame, columns, what: str = "table") -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: {', '.join(missing)}")
