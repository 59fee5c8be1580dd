"""Sinks: documents by route, result lines. Writers replace what a run left behind only at its own path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_routed(docs: DataFrame, path: str, kind: str = "kind") -> None:
    """Parquet with a folder for each kind, so that readers of one kind skip the others."""
    docs.write.mode("overwrite").partitionBy(kind).parquet(path)


def write_lines(rows: DataFrame, path: str) -> None:
    """One JSON object a line; nulls are left out."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(path)
