"""The core's queries against SQL, and its operators on small cases."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkquarry.functions import boxes as X
from sparkquarry.functions import text as T
from sparkquarry.operators import evidence, fusion, geometry, lexical, markdown, metrics, tables, vectors
from sparkquarry.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}/*.parquet')" if f.is_dir() else f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


def _norm(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, list | tuple):
        return tuple(map(_norm, v))
    return float(v) if type(v).__name__ == "Decimal" else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    r = db.sql(SQL[name])
    assert sorted(df.columns) == sorted(r.columns)
    got = sorted(repr(tuple(_norm(x[c]) for c in sorted(df.columns))) for x in df.collect())
    want = sorted(repr(tuple(_norm(x[r.columns.index(c)]) for c in sorted(r.columns))) for x in r.fetchall())
    assert got == want


#: Queries that SQL can't express, by the test that says what they give.
TESTED = {
    "a19_cell_rows": "test_cell_rows", "a20_a21_a22_visual_lines": "test_visual_lines", "f32_extraction_windows": "test_extraction_windows", "j04_focused_overwrite": "test_overwriting", "s06_routed_sink": "test_routed_sink_counts",
    "stream_admission": "test_admission_in_order_of_arrival", "t17_evidence_units": "test_units_keep_their_places", "t18_reconstruct": "test_units_and_reconstruction", "t30_t31_page_blocks": "test_page_blocks", "w11_admission": "test_admission_of_scored_units",
    "w14_region_suppression": "test_suppression", "w02_indexed_top_k": "test_index", "w17_t22_t23_t25_passages": "test_window_passages",
}


def test_every_query_is_tested():
    source = "".join(p.read_text() for p in Path(__file__).parent.glob("test_*.py"))
    assert set(QUERIES) - set(SQL) == set(TESTED) and all(f"def {t}(" in source for t in TESTED.values())


@pytest.mark.parametrize("name", sorted(set(TESTED) - {"stream_admission"}))
def test_query_gives_rows(spark, sf, name):
    rows = QUERIES[name](spark, sf).limit(5).collect()
    assert rows and all(any(v is not None for v in r) for r in rows)


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "c string").select(*columns).first()


def test_terms(spark):
    r = one(spark, "USB_TEST fw-3.0.12 电池x", T.terms(F.col("c")).alias("t"), T.passage_terms(F.col("c")).alias("p"))
    assert r.t == ["usb_test", "usb", "test", "fw-3.0.12", "fw", "3", "0", "12", "fw3012", "电", "池", "电池", "x"] and r.p == ["usb_test", "fw-3.0.12", "电池", "x"]


@pytest.mark.parametrize(("q", "profile"), [("decode 性能", "table"), ("call queue 设置为 default destination", "relation_fact"), ("which modes are there", "document_fact"), ("What is 0x3F?", "exact"), ("give an overview of it please, and go on for more than forty-eight characters", "semantic"), ("hello there", "balanced"), ("", "balanced")])
def test_profiles(spark, q, profile):
    assert one(spark, q, T.retrieval_profile(F.col("c")).alias("p")).p == profile


def test_functions_of_null(spark):
    df = spark.createDataFrame([(None,)], "c string")
    r = df.select(T.terms(F.col("c")).alias("a"), T.valid_chunk_id(F.col("c")).alias("b"), T.without_footer(F.col("c")).alias("d"), T.named_phrases(F.col("c")).alias("e"), T.relation_anchors(F.col("c")).alias("f")).first()
    assert r.a is None and r.b is False and r.d is None and r.e is None and r.f is None


def test_tightest_span(spark):
    df = spark.createDataFrame([("aa b  aab", "aa", "b"), ("x", "a", "b"), (None, "a", "b")], "c string, a string, b string")
    assert [r[0] for r in df.select(T.tightest_span("a", "b", "c")).collect()] == [2, None, None]


def test_bm25_ties_and_empty(spark):
    chunks = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, "gamma"), (4, "")], "chunk_id int, content string")
    q = spark.createDataFrame([(1, "alpha"), (2, "zzz"), (3, None)], "query_id int, query string")
    out = lexical.bm25(chunks, q).collect()
    assert [(r.query_id, r.chunk_id, r["rank"]) for r in out] == [(1, 1, 1), (1, 2, 2)] and out[0].score > 2
    assert lexical.bm25(chunks.limit(0), q).count() == 0


def test_cosine(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [2.0, 0.0])], "vec_id int, embedding array<double>")
    q = v.where("vec_id in (1, 4, 5)").select(F.col("vec_id").alias("query_id"), "embedding")
    assert [(r.query_id, r.vec_id, r["rank"]) for r in vectors.cosine_top_k(v, q, 2).collect()] == [(1, 1, 1), (1, 6, 2)]
    assert vectors.cosine_top_k(v, q.limit(0), 2).count() == 0


def test_fusion(spark):
    q = spark.createDataFrame([(1, "hello there")], "query_id int, query string")
    lists = [spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(x)], "query_id int, chunk_id string, rank int") for x in (["a", "b", "c"], ["c", "d"])]
    assert [r.chunk_id for r in fusion.fuse(*lists, q).orderBy("rank").collect()] == ["c", "d", "a", "b"]
    assert [r.chunk_id for r in fusion.round_robin(*lists).orderBy("position").collect()] == ["a", "c", "b", "d"]
    out = fusion.protect(lists[0], spark.createDataFrame([(1, "z")], "query_id int, chunk_id string"))
    assert sorted((r.chunk_id, r["rank"]) for r in out.collect()) == [("a", 1), ("b", 2), ("z", 3)]


MD = "# A\nintro\n\n## B\n```\n# no heading\n\ncode\n```\n| x | y |\n|---|---|\n| 1 | 2 |\nafter\n\n# C\n"


def test_markdown(spark):
    docs = spark.createDataFrame([("d", MD), ("e", None), ("f", "")], "k string, t string")
    assert [(r.heading, r.level, r.first_line, r.end_line) for r in markdown.sections(docs, "k", "t").orderBy("first_line").collect()] == [("A", 1, 0, 14), ("B", 2, 3, 14)]
    assert [(r.path, r.n_lines, r.reason) for r in markdown.blocks(docs, "k", "t").orderBy("block_no").collect()] == [(["A"], 1, "semantic_prose"), (["A", "B"], 5, "fenced_code"), (["A", "B"], 3, "markdown_table"), (["A", "B"], 1, "semantic_prose")]
    assert [(r.header, r.n_rows) for r in markdown.pipe_tables(docs, "k", "t").collect()] == [(["x", "y"], 1)]


def test_extraction_windows(spark):
    text = "One short sentence. " * 30 + "x" * 500
    out = one(spark, text, markdown.extraction_windows(F.col("c"), 100).alias("w")).w
    assert all(len(w) <= 100 for w in out) and len(out) > 10
    assert one(spark, " short ", markdown.extraction_windows(F.col("c")).alias("w")).w == ["short"]


def test_html_rows(spark):
    r = one(spark, "<table><TR><th>a<th>b</tr><tr><td>1</td><td>x<b>y</b></td></tr><tr><td>2</tr></table>", tables.html_rows(F.col("c")).alias("r"), tables.rectangular(tables.html_rows(F.col("c"))).alias("q"))
    assert r.r == [["a", "b"], ["1", "xy"], ["2"]] and r.q == [["a", "b"], ["1", "xy"]]


def test_boxes(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 5.0, 20.0, 20.0)], "x0 double, y0 double, x1 double, y1 double, r_x0 double, r_y0 double, r_x1 double, r_y1 double")
    r = df.select(X.overlap(X.box(), X.box("r_")).alias("o"), X.inside(X.box(), X.box("r_")).alias("i"), X.area(X.box()).alias("a")).first()
    assert (r.o, r.i, r.a) == (25.0, True, 100.0)


def test_suppression(spark):
    df = spark.createDataFrame([(1, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 2, 0.8, 0.0, 0.0, 10.0, 9.0), (1, 3, 0.7, 20.0, 0.0, 30.0, 9.0), (2, 4, None, 0.0, 0.0, 1.0, 1.0)], "page_uid bigint, id bigint, s double, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.id for r in geometry.suppress(df, "id", "s").collect()) == [1, 3, 4]


def test_fifo(spark):
    df = spark.createDataFrame([("s", 0.0, 5.0, 1), ("s", 1.0, 2.0, 2), ("s", 20.0, 1.0, 3)], "k string, t double, v double, id int")
    assert [(r.start, r.end) for r in metrics.fifo(df, ["k"], "t", "v", "id").orderBy("id").collect()] == [(0.0, 5.0), (5.0, 7.0), (20.0, 21.0)]


def test_nearest_rank(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 2, 3, 9)] + [("a", None), (None, 4.0)], "k string, v double")
    assert {(r.k, r.n, r.v) for r in metrics.nearest_rank(df, ["k"], "v", 0.95).collect()} == {("a", 5, 9.0), (None, 1, 4.0)}


def test_relative_floor(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.5), (1, "c", 0.2), (2, "d", 0.1), (2, "e", 0.01)], "query_id int, chunk_id string, score double")
    assert sorted(r.chunk_id for r in evidence.relative_floor(df, 0.5, 0.3, 2).collect()) == ["a", "b", "d", "e"]


def test_core_stands_alone():
    root = Path(registry.__file__).parents[1]
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "sparkquarry.llm" in p.read_text()]


def test_cell_rows(spark):
    rows = [(1, i, float(x), y, y + 10) for i, (x, y) in enumerate([(50, 1.0), (0, 0.0), (0, 20.0), (50, 25.0), (0, 60.0)])] + [(2, 9, 0.0, 0.0, 1.0), (2, 10, 0.0, None, 1.0)]
    df = spark.createDataFrame(rows, "page_uid bigint, cell bigint, x0 double, y0 double, y1 double")
    assert sorted((r.page_uid, r.cell, r.row_no) for r in geometry.row_clusters(df, "cell").collect()) == [(1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2), (2, 9, 0)]


def test_visual_lines(spark):
    rows = [(1, 1, "a", False, 0.0, 0.0, 5.0, 10.0), (1, 2, "b", False, 5.0, 1.0, 10.0, 11.0), (1, 3, "c", False, 20.0, 0.0, 25.0, 10.0), (1, 4, "d", True, 0.0, 20.0, 5.0, 30.0), (1, 5, "e", True, 5.0, 20.0, 9.0, 30.0)]
    g = spark.createDataFrame(rows, "page_uid bigint, glyph_id bigint, text string, space_before boolean, x0 double, y0 double, x1 double, y1 double")
    out = geometry.line_texts(g.join(geometry.visual_lines(g), ["page_uid", "glyph_id"])).orderBy("line_no").collect()
    assert [(r.line_no, r.text, r.x0, r.y0, r.x1, r.y1) for r in out] == [(0, "ab c", 0.0, 0.0, 25.0, 11.0), (1, "d e", 0.0, 20.0, 9.0, 30.0)]


def test_overwriting(spark):
    rows = spark.createDataFrame([(1, "a", "long text"), (1, "b", "same"), (1, "c", None), (2, "a", "other")], "query_id int, chunk_id string, content string")
    focused = spark.createDataFrame([(1, "a", "text"), (1, "b", "same"), (1, "c", "x"), (3, "a", "y")], "query_id int, chunk_id string, content string")
    assert sorted((r.query_id, r.chunk_id, r.content, r.changed) for r in fusion.overwrite(rows, focused).collect()) == [(1, "a", "text", True), (1, "b", "same", False), (1, "c", "x", True), (2, "a", "other", False)]


def test_routed_sink_counts(spark, sf):
    from sparkquarry.plans import common as C

    written = {(r.kind, r.reason): r.n for r in QUERIES["s06_routed_sink"](spark, sf).collect()}
    blocks = markdown.blocks(C.markdown(spark, sf), "document_name", "markdown")
    assert written == {(r.kind, r.reason): r["count"] for r in blocks.groupBy("kind", "reason").count().collect()}


def test_index(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    mids = rng.normal(size=(12, 8))
    rows = [(i, (mids[i % 12] + 0.3 * rng.normal(size=8)).tolist()) for i in range(600)] + [(i, mids[0].tolist()) for i in range(600, 900)] + [(900, [0.0] * 8), (901, None)]
    v = spark.createDataFrame(rows, "vec_id int, embedding array<double>").repartition(4)
    q = v.where("vec_id % 30 = 0 or vec_id = 901").select(F.col("vec_id").alias("query_id"), "embedding")
    index = vectors.build_index(v)
    assert index.rows.count() == 900
    found = {(r.query_id, r.vec_id): r.similarity for r in vectors.indexed_top_k(index, q).collect()}
    true = {(r.query_id, r.vec_id): r.similarity for r in vectors.cosine_top_k(v, q).collect()}
    assert len(found.keys() & true.keys()) >= 0.9 * len(true) and all(abs(found[k] - true[k]) < 1e-8 for k in found.keys() & true.keys())
    assert vectors.indexed_top_k(index, q.limit(0)).count() == 0 and vectors.indexed_top_k(vectors.build_index(v.limit(0)), q).count() == 0
