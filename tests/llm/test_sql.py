"""The problems' queries against their SQL."""

from pathlib import Path

import duckdb
import pytest

registry = pytest.importorskip("sparkquarry.llm.registry")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    df, r = registry.queries()[name](spark, sf), c.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(r.columns)
    got = sorted(repr(tuple(x[k] for k in sorted(df.columns))) for x in df.collect())
    assert got == sorted(repr(tuple(x[r.columns.index(k)] for k in sorted(r.columns))) for x in r.fetchall())
