"""Every query of the problems on tables without rows, and on tables with rows of nothing but nulls."""

import os

import pytest
from pyspark.sql import functions as F

registry = pytest.importorskip("sparkquarry.llm.registry")

FIXED = {"size_limits", "container_specs", "percentile_grid", "language_codes"}
NEEDED = ["documents", "parsed_pages", "ocr_texts", "native_glyphs", "blocks", "ir_blocks", "ir_tables", "eval_results", "vector_perf", *FIXED]


@pytest.fixture(scope="module", params=["empty", "nulls"])
def folder(request, spark, sf, tmp_path_factory):
    out = str(tmp_path_factory.mktemp(request.param))
    for name in NEEDED:
        df = spark.read.parquet(os.path.join(sf, f"{name}.parquet"))
        if name not in FIXED:
            nulls = df.limit(3).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema))
            df = df.limit(0) if request.param == "empty" else nulls.unionByName(df.limit(30))
        df.coalesce(1).write.parquet(f"{out}/{name}.parquet")
    return out


@pytest.mark.parametrize("name", sorted(k for k in registry.queries() if k != "p1_months"))
def test_edge_tables(spark, folder, name):
    rows = registry.queries()[name](spark, folder).count()
    if "empty" in folder:
        assert rows == 0
