"""Queues, ranks and sessions on small cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparkquarry import session
from sparkquarry.operators import metrics as M
from sparkquarry.sources import spread
from sparkquarry.streaming import metrics as SM


def _queue(rows, capacity):
    """One request at a time in the order of arrival, by brute force."""
    out, ends = {}, {}
    for server, t, ms in sorted(rows, key=lambda r: r[1]):
        waiting = [e for e in ends.get(server, []) if e > t]
        if len(waiting) > capacity:
            out[server, t] = (None, None, False)
        else:
            begin = max(t, waiting[-1]) if waiting else t
            waiting.append(begin + ms / 1000)
            out[server, t] = (begin, waiting[-1], True)
        ends[server] = waiting
    return out


def test_admission_in_order_of_arrival(spark, tmp_path):
    rng = random.Random(4)
    rows = [(s, 1_767_225_600.0 + i * 2.0 + 0.5 * (s == "b"), rng.choice([500.0, 3000.0, 15000.0])) for s in "ab" for i in range(80)]
    batches = [rows[i::4] for i in range(4)]  # each file has requests of all times
    schema = "server string, ts timestamp, ms double"
    for n, part in enumerate(batches):
        rng.shuffle(part)
        spark.createDataFrame([(s, dt.datetime.fromtimestamp(t, dt.UTC), ms) for s, t, ms in part], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if n == 3:  # a last one drives the watermark past all others
            spark.createDataFrame([("c", dt.datetime.fromtimestamp(1_767_239_600, dt.UTC), 1.0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = SM.run_available(SM.admission(stream, "server", "ts", "ms", capacity=3, late="1 hour")).collect()
    got = {(r.server, r.arrival): (r.started, r.ended, r.admitted) for r in out}
    want = _queue(rows, 3)
    assert got.keys() == want.keys() and any(not x[2] for x in got.values())
    assert all(g[2] == want[k][2] and g[:2] == (pytest.approx(want[k][0]) if g[2] else None, pytest.approx(want[k][1]) if g[2] else None) for k, g in got.items())


def test_ranks_of_hot_groups(spark):
    rng = random.Random(5)
    values = [float(rng.randint(0, 4000)) for _ in range(9000)]
    rows = [("hot", v) for v in values] + [(None, 1.0), (None, 3.0), ("cold", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    r = M.ranked(df, ["k"], "v").where("k = 'hot'").orderBy("v").collect()
    assert [x._upto for x in r] == [sum(v <= x.v for v in values) for x in r] and {x.n for x in r} == {9000}
    got = {x.k: (x.n, x.v) for x in M.quantile(df, ["k"], "v", 0.5).collect()}
    ordered = sorted(values)
    assert got == {"hot": (9000, (ordered[4499] + ordered[4500]) / 2), None: (2, 2.0)}
    assert M.quantile(df.limit(0), ["k"], "v", 0.5).count() == 0
    one = M.latency_summary(df, ["k"], "v", F.lit(False)).where("k = 'cold'").first()
    assert (one.n, one.median, one.p95) == (0, None, None)


def test_rollup(spark):
    t = [dt.datetime(2026, 1, d) for d in (1, 2, 3, 4)]
    df = spark.createDataFrame([("a", "done", t[0], 5), ("a", "failed", t[2], 6), ("a", "failed", t[1], 7), ("b", None, t[3], 1), ("b", "odd", t[0], 1)], "k string, s string, at timestamp, n int")
    out = {r.k: r for r in M.rollup(df, ["k"], F.col("s"), ["failed", "done"], "at", total="n").collect()}
    assert (out["a"].status, out["a"].status_since, out["a"].members, out["a"].total, out["a"].updated) == ("failed", t[1], 3, 18, t[2]) and out["b"].members == 2


def test_spread_runs_nothing(spark):
    seen = []
    df = spark.range(100).select("id", F.udf(lambda x: seen.append(x) or x, "bigint")("id").alias("x"))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    wide = spread(df.groupBy("id").agg(F.sum("x").alias("x")), "id")
    assert list(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) == list(jobs) and wide.count() == 100


def test_clusters_need_a_shared_folder(monkeypatch):
    class Sc:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda s: type("S", (), {"getCheckpointDir": lambda s: type("O", (), {"isDefined": lambda s: False})()})()})()

    class Spark:
        sparkContext = Sc()
        conf = type("C", (), {"get": lambda s, k, d: d})()

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.shared_base(Spark())
