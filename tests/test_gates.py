"""Gates, table functions and sinks on small cases."""

from pyspark.sql import functions as F

from sparkquarry.operators import evidence, gates, metrics, tables, udtf
from sparkquarry.sources import sinks


def test_keep_if_any(spark):
    df = spark.createDataFrame([(1, "a", True), (1, "b", None), (2, "c", False), (2, "d", None)], "query_id int, chunk_id string, f boolean")
    assert sorted(r.chunk_id for r in gates.keep_if_any(df, "f").collect()) == ["a", "c", "d"]


def test_coverage_gate(spark):
    rows = [(1, "a", True, True), (1, "b", True, False), (1, "c", False, None), (2, "d", True, False), (2, "e", None, None)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, typed boolean, passed boolean")
    assert sorted(r.chunk_id for r in gates.coverage_gate(df, "typed", "passed").collect()) == ["a", "e"]


def test_protected_evidence(spark):
    q = spark.createDataFrame([(1, "set DDR4 now"), (2, "which modes are there"), (3, "hello there")], "query_id int, query string")
    long = " and then some more words about it"
    c = spark.createDataFrame([(1, "a", 1, None, "x" + long), (1, "b", 2, 1, "ddr4" + long), (2, "c", 1, None, "short"), (2, "d", 2, None, "modes" + long), (3, "e", 1, 1, "hello" + long)], "query_id int, chunk_id string, rank int, lexical_rank int, content string")
    assert sorted((r.query_id, r.chunk_id, r.why) for r in gates.protected_evidence(c, q).collect()) == [(1, "b", "named"), (2, "d", "fact")]


def test_table_function(spark):
    udtf.register(spark)
    spark.createDataFrame([("# A\n- one\n- two",), (None,)], "c string").createOrReplaceTempView("units_in")
    assert [(r.kind, r.text, r.section) for r in spark.sql("SELECT u.* FROM units_in, LATERAL evidence_units(c) u").collect()] == [("list_item", "- one", "A"), ("list_item", "- two", "A")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("kg", "a"), ("text", "b"), ("text", None)], "kind string, t string")
    sinks.write_routed(df, str(tmp_path / "r"))
    assert {p.name for p in (tmp_path / "r").iterdir() if p.is_dir()} == {"kind=kg", "kind=text"} and spark.read.parquet(str(tmp_path / "r")).where("kind = 'text'").count() == 2
    sinks.write_lines(df, str(tmp_path / "l"))
    sinks.write_lines(df.limit(0), str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).agg(F.count("t")).first()[0] == 2


def _policy(spark, rows):
    names = "query_id int, chunk_id string, rank int, score double, file_path string, family string, content string, relation boolean, diagnostic boolean, parent boolean, named int, protected boolean, hits int, `table` boolean"
    out = evidence.authority(spark.createDataFrame(rows, names), "%derived%").orderBy("query_id", "final_rank").collect()
    return [(r.query_id, r.chunk_id) for r in out], {(r.query_id, r.chunk_id): r.score for r in out}


def test_source_policy(spark):
    long = "x" * 200
    row = lambda q, c, rank, score, path="a.md", relation=False, diagnostic=False, parent=False, named=0, protected=False, hits=0, table=False, content=long: (q, c, rank, score, path, "f", content, relation, diagnostic, parent, named, protected, hits, table)
    rows = [
        row(1, "a", 1, 0.9, parent=False), row(1, "b", 2, 0.1, parent=True),  # the type asked for goes before all
        row(2, "a", 1, 0.9, named=1), row(2, "b", 2, 0.8, named=2), row(2, "c", 3, 0.7, protected=True, hits=2), row(2, "d", 4, 0.6, named=2),  # most named and protected, of these the protected
        row(3, "a", 1, 0.9, named=1), row(3, "b", 2, 0.8, named=2, relation=True, protected=True), row(3, "c", 3, None, relation=True),
        row(4, "a", 1, 0.9), row(4, "b", 2, 0.5, table=True),
        row(5, "a", 1, 0.9, "x.kg.md", diagnostic=True), row(5, "b", 2, 0.8, "x.text.md", diagnostic=True), row(5, "c", 3, 0.7, "y.md", diagnostic=True), row(5, "d", 4, 0.6, "y.md", diagnostic=True), row(5, "e", 5, 0.1, "y.md", diagnostic=True),
        row(6, "a", 1, 0.4, "derived.md"), row(6, "b", 2, 0.3, content="thin"), row(6, "c", 3, 0.2, hits=3),
        row(7, "a", 1, 0.4, "x.kg.md", diagnostic=True), row(7, "b", 2, 0.3, "z.kg.md", diagnostic=True),
    ]
    got, score = _policy(spark, [(*r[:7], r[7] or r[0] == 3, *r[8:]) for r in rows])
    assert [c for q, c in got if q == 1] == ["b"] and [c for q, c in got if q == 2] == ["c"] and [c for q, c in got if q == 3] == ["a", "b", "c"] and [c for q, c in got if q == 4] == ["b"]
    assert [c for q, c in got if q == 5] == ["b", "c"] and [c for q, c in got if q == 6] == ["c", "a", "b"] and [c for q, c in got if q == 7] == ["a", "b"]
    assert abs(score[6, "a"] - 0.08) < 1e-9 and abs(score[6, "b"] - 0.075) < 1e-9 and abs(score[6, "c"] - 0.44) < 1e-9 and abs(score[4, "b"] - 0.75) < 1e-9 and score[3, "c"] is None
    assert _policy(spark, rows[:0] or [])[0] == []


def test_quotes_in_sources(spark):
    q = spark.createDataFrame([("a", "Pump set"), ("a", "no such"), ("b", "pump set"), (None, "x"), ("a", ""), ("a", None)], "source string, quote string")
    docs = spark.createDataFrame([("a", "the PUMP SET is"), ("a", None), ("b", "other"), (None, "x")], "source string, text string")
    assert list(map(tuple, evidence.quotes_in_sources(q, docs, 1).collect())) == [("a", "pump set")] and evidence.quotes_in_sources(q.limit(0), docs).count() == 0


def test_parent_index(spark):
    p, s = spark.createDataFrame([("a",), ("b",)], "table_id string"), spark.createDataFrame([("b", 1), ("c", 2), (None, 3)], "table_id string, n int")
    assert sorted(map(str, (r.table_id for r in tables.parent_index(p, s).collect()))) == ["None", "a", "b", "c"]


def test_table_types(spark):
    types = [("power", ["power", "fuse"]), ("net", ["bridge"])]
    df = spark.createDataFrame([("Spare Fuse", "x", "which fuse"), ("Plain", "a bridge, the Bri-dge and bridge", "a BRIDGE"), (None, "power", "else"), (None, None, None), ("bridge", "fuse fuse fuse", "fuse bridge")], "h string, b string, q string")
    rows = df.select(tables.table_type(F.col("h"), F.col("b"), types).alias("t"), tables.asked_type(F.col("q"), types).alias("a")).collect()
    assert [(r.t, r.a) for r in rows] == [("power", "power"), ("net", "net"), ("unknown", None), ("unknown", None), ("net", "power")]


def test_positions(spark):
    df = spark.createDataFrame([("s", 0.0, 5.0, 1), ("s", 1.0, 2.0, 2), ("s", 2.0, 1.0, 3), ("s", 8.0, 1.0, 4), ("z", 2.0, 1.0, 5)], "k string, t double, v double, id int")
    served = metrics.fifo(df, ["k"], "t", "v", "id")
    assert sorted((r.id, r.position) for r in metrics.positions(served, ["k"], "t", "end", "id").collect()) == [(1, 0), (2, 1), (3, 2), (4, 0), (5, 0)]
