"""Table functions for SQL: after ``register(spark)``, ``SELECT ... FROM t, LATERAL evidence_units(t.text)``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from sparkquarry.operators.passages import _units


class EvidenceUnits:
    """Rows of kind, text, start, end, section and header for a text; none for null."""

    def eval(self, text: str):
        if text is not None:
            yield from _units(text)


def register(spark: SparkSession) -> None:
    spark.udtf.register("evidence_units", udtf(EvidenceUnits, returnType="kind string, text string, start int, `end` int, section string, header string"))
