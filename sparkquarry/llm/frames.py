"""Pandas frames on their way back to Spark."""

from __future__ import annotations

import pandas as pd


def integers(frame: pd.DataFrame, *columns: str) -> pd.DataFrame:
    """Columns that nulls turned into floats as nullable integers again."""
    for c in columns:
        if frame[c].dtype.kind in "fO":
            frame[c] = frame[c].astype("Int64")
    return frame


def integer_columns(schema) -> list[str]:
    return [f.name for f in schema if f.dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")]
