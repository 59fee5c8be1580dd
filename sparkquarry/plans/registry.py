"""The core's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkquarry.plans import functions_q, gates_q, metrics_q, passages_q, retrieval_q, structure_q

MODULES = [retrieval_q, functions_q, structure_q, passages_q, gates_q, metrics_q]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["a05_j3_w3_w4_rrf"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.Q.items()}


def oracle_sql() -> dict[str, str]:
    return {k: f for m in MODULES for k, f in m.S.items()}
