"""Queries of latency, usage, evaluation and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkquarry.operators import metrics as M
from sparkquarry.sources import load
from sparkquarry.streaming import metrics as SM

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


_ONCE = "(SELECT result_id, case_id, category, origin, answerability, run_idx, query_model, query_mode, question, answer, error, http_status, ttft_ms, total_ms, cited_references, assessment, started_at FROM eval_results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY received_at) = 1)"


def results(s, d):
    return M.last_run(load(s, d, "eval_results"), ["result_id"], F.col("received_at"))


@query("a10_latency_summary", f"SELECT query_model, query_mode, count(total_ms) AS n, count_if(http_status <> 200) AS errors, round(median(total_ms), 1) AS median, min(total_ms) AS least, max(total_ms) AS greatest, list_sort(list(total_ms))[CAST(round_even((count(total_ms) - 1) * 0.95, 0) AS BIGINT) + 1] AS p95 FROM (SELECT * REPLACE (CASE WHEN total_ms >= 0 THEN total_ms END AS total_ms) FROM {_ONCE}) GROUP BY ALL")
def _(s, d):
    r = results(s, d).withColumn("total_ms", F.when(F.col("total_ms") >= 0, F.col("total_ms")))
    return M.latency_summary(r, ["query_model", "query_mode"], "total_ms", F.col("http_status") != 200)


@query("a11_interpolated_p95", "SELECT kind, profile, batch_size, round(quantile_cont(internal_ms_p95, 0.95), 6) AS p95, count(internal_ms_p95) AS n FROM vector_perf WHERE internal_ms_p95 >= 0 GROUP BY ALL")
def _(s, d):
    q = M.quantile(load(s, d, "vector_perf").where("internal_ms_p95 >= 0"), ["kind", "profile", "batch_size"], "internal_ms_p95", 0.95)
    return q.select("kind", "profile", "batch_size", F.round("internal_ms_p95", 6).alias("p95"), "n")


@query("a12_all_or_null_sums", "SELECT run_id, kind, CASE WHEN count(internal_ms_median) = count(*) THEN round(sum(internal_ms_median), 4) END AS total_ms, CASE WHEN count(vector_dimensions) = count(*) THEN CAST(sum(vector_dimensions) AS BIGINT) END AS dimensions FROM vector_perf GROUP BY ALL")
def _(s, d):
    return load(s, d, "vector_perf").groupBy("run_id", "kind").agg(F.round(M.all_or_null(F.col("internal_ms_median")), 4).alias("total_ms"), M.all_or_null(F.col("vector_dimensions")).alias("dimensions"))


@query("a13_queries_per_minute", f"SELECT query_model, count_if(http_status = 200) AS valid, round(count_if(http_status = 200) * 60.0 / nullif(sum(greatest(total_ms, 0)) / 1000.0, 0), 4) AS qpm FROM {_ONCE} GROUP BY query_model")
def _(s, d):
    ok = F.count_if(F.col("http_status") == 200)
    return results(s, d).groupBy("query_model").agg(ok.alias("valid"), F.round(F.try_divide(ok * 60.0, F.sum(F.greatest("total_ms", F.lit(0.0))) / 1000.0), 4).alias("qpm"))


_FIELDS = ["retrieval_hit", "grounded", "answer_correct"]


_SUMMED = {"api_ok": "CASE WHEN http_status = 200 AND coalesce(error, '') = '' THEN 'yes' ELSE 'no' END", "sources_cited": "CASE WHEN len(cited_references) > 0 THEN 'yes' ELSE 'no' END", "reviewed": "CASE WHEN assessment IS NULL THEN 'no' ELSE 'yes' END"}


@query("a14_assessment_summary", " UNION ALL ".join([*(f"SELECT '{f}' AS field, coalesce(assessment.{f}, 'unknown') AS value, count(*) AS n FROM {_ONCE} GROUP BY ALL" for f in _FIELDS), *(f"SELECT '{k}', {v}, count(*) FROM {_ONCE} GROUP BY ALL" for k, v in _SUMMED.items())]))
def _(s, d):
    yes = lambda c: F.when(F.coalesce(c, F.lit(False)), "yes").otherwise("no")
    values = {f: F.coalesce(F.col(f"assessment.{f}"), F.lit("unknown")) for f in _FIELDS}
    values |= {"api_ok": yes((F.col("http_status") == 200) & (F.coalesce("error", F.lit("")) == "")), "sources_cited": yes(F.size("cited_references") > 0), "reviewed": yes(F.col("assessment").isNotNull())}
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in values.items())))
    return results(s, d).select(pairs.alias("p")).select("p.*").groupBy("field", "value").agg(F.count("*").alias("n"))


@query("a15_a26_cited_sources", f"SELECT result_id, array_to_string(list_sort(list_distinct(list_transform(cited_references, lambda r: r.file_path))), '|') AS sources, len(cited_references) AS n, CASE WHEN answer IS NULL THEN NULL ELSE contains(answer, case_id) END AS visible FROM {_ONCE} WHERE cited_references IS NOT NULL")
def _(s, d):
    r = results(s, d).where("cited_references is not null")
    paths = F.filter(F.transform("cited_references", lambda x: x["file_path"]), lambda p: p.isNotNull())
    return r.select("result_id", F.array_join(F.array_sort(F.array_distinct(paths)), "|").alias("sources"), F.size("cited_references").cast("bigint").alias("n"), F.contains("answer", F.col("case_id")).alias("visible"))


@query("a15b_review_coercion", f"SELECT result_id, CASE WHEN assessment.grounded IN ('yes', 'no', 'partial', 'pass', 'fail') THEN assessment.grounded ELSE 'unknown' END AS grounded, CASE WHEN http_status <> 200 THEN 'api_error' ELSE 'none' END AS failure, CASE WHEN http_status <> 200 AND assessment.answer_correct IS NULL THEN 'fail' ELSE coalesce(assessment.answer_correct, 'unknown') END AS correct FROM {_ONCE}")
def _(s, d):
    g, bad = F.col("assessment.grounded"), F.col("http_status") != 200
    return results(s, d).select(
        "result_id", F.when(g.isin("yes", "no", "partial", "pass", "fail"), g).otherwise("unknown").alias("grounded"), F.when(bad, "api_error").otherwise("none").alias("failure"),
        F.when(bad & F.col("assessment.answer_correct").isNull(), "fail").otherwise(F.coalesce(F.col("assessment.answer_correct"), F.lit("unknown"))).alias("correct"),
    )


@query("a16_non_model_residual", f"SELECT query_mode, round(median(total_ms - ttft_ms), 3) AS after_first, count(*) AS n FROM {_ONCE} WHERE total_ms >= 0 AND ttft_ms >= 0 GROUP BY query_mode")
def _(s, d):
    r = results(s, d).where("total_ms >= 0 and ttft_ms >= 0").select("query_mode", (F.col("total_ms") - F.col("ttft_ms")).alias("after_first"))
    return M.quantile(r, ["query_mode"], "after_first", 0.5).select("query_mode", F.round("after_first", 3).alias("after_first"), "n")


_ALLOWED = {"answerability": ["answerable", "partial"], "category": ["procedure", "fault", "overview", "table", "identifier"]}


@query("a17_dataset_validation", "SELECT 'duplicate_id' AS violation, CAST(result_id AS VARCHAR) AS id, count(*) AS n FROM eval_results GROUP BY result_id HAVING count(*) > 1 UNION ALL SELECT 'missing_answer', CAST(result_id AS VARCHAR), 1 FROM eval_results WHERE answer IS NULL UNION ALL SELECT 'missing_question', CAST(result_id AS VARCHAR), 1 FROM eval_results WHERE question IS NULL "
    + "".join(f"UNION ALL SELECT 'unknown_{c}', {c}, count(*) FROM eval_results WHERE {c} IS NOT NULL AND {c} NOT IN ({', '.join(repr(v) for v in vs)}) GROUP BY {c} " for c, vs in _ALLOWED.items())
    + "UNION ALL SELECT 'category_count', category, count(*) FROM eval_results GROUP BY category UNION ALL SELECT 'over_half_of_origin', origin || ':' || category, n FROM (SELECT *, sum(n) OVER (PARTITION BY origin) AS t FROM (SELECT origin, category, count(*) AS n FROM eval_results WHERE origin IS NOT NULL AND category IS NOT NULL GROUP BY origin, category)) WHERE n * 2 > t")
def _(s, d):
    """Repeated ids, missing fields, values outside their set, counts by category, and categories that are more than half of an origin."""
    e = load(s, d, "eval_results").select("result_id", "answer", "question", "category", "origin", "answerability")
    id_of = F.col("result_id").cast("string").alias("id")
    one = F.lit(1).cast("bigint").alias("n")
    out = e.groupBy("result_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_id").alias("violation"), id_of, "n")
    for c in ("answer", "question"):
        out = out.unionByName(e.where(F.col(c).isNull()).select(F.lit(f"missing_{c}").alias("violation"), id_of, one))
    for c, values in _ALLOWED.items():
        out = out.unionByName(e.where(F.col(c).isNotNull() & ~F.col(c).isin(values)).groupBy(F.col(c).alias("id")).agg(F.count("*").alias("n")).withColumn("violation", F.lit(f"unknown_{c}")))
    out = out.unionByName(e.groupBy(F.col("category").alias("id")).agg(F.count("*").alias("n")).withColumn("violation", F.lit("category_count")))
    share = e.where("origin is not null and category is not null").groupBy("origin", "category").agg(F.count("*").alias("n")).withColumn("t", F.sum("n").over(Window.partitionBy("origin"))).where("n * 2 > t")
    return out.unionByName(share.select(F.lit("over_half_of_origin").alias("violation"), F.concat("origin", F.lit(":"), "category").alias("id"), "n"))


@query("a25_effective_rates", "SELECT perf_id, round_even(total_chars * 1000 / nullif(internal_ms_median, 0), 2) AS rate FROM vector_perf")
def _(s, d):
    return load(s, d, "vector_perf").select("perf_id", M.rate(F.col("total_chars"), F.nullif(F.col("internal_ms_median"), F.lit(0.0))).alias("rate"))


@query("a09_sibling_rollup", r"SELECT full_doc_id, regexp_replace(source, '\.(kg|text)\.md$', '.md') AS family, CAST(sum(n_chars) AS BIGINT) AS length, count(*) AS chunks, epoch_us(max(updated_at)) AS updated_us, bool_or(source LIKE '%.kg.md') AS has_kg FROM documents WHERE source IS NOT NULL GROUP BY ALL")
def _(s, d):
    from sparkquarry.functions.text import source_family

    g = load(s, d, "documents").where("source is not null").groupBy("full_doc_id", source_family(F.col("source")).alias("family"))
    return g.agg(F.sum("n_chars").alias("length"), F.count("*").alias("chunks"), F.unix_micros(F.max("updated_at")).alias("updated_us"), F.bool_or(F.col("source").like("%.kg.md")).alias("has_kg"))


_SEVERITY = ["F", "P", "O"]


@query("a09_status_rollup", "WITH r AS (SELECT *, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 WHEN 'O' THEN 3 ELSE 4 END AS w FROM orders) SELECT o_custkey, arg_min(o_orderstatus, w) AS status, epoch_us(min(o_orderdate) FILTER (WHERE w = m)) AS since_us, count(*) AS members, epoch_us(min(o_orderdate)) AS created_us, epoch_us(max(o_orderdate)) AS updated_us, round(sum(o_totalprice), 2) AS total FROM (SELECT *, min(w) OVER (PARTITION BY o_custkey) AS m FROM r) GROUP BY o_custkey")
def _(s, d):
    r = M.rollup(load(s, d, "orders"), ["o_custkey"], F.col("o_orderstatus"), _SEVERITY, "o_orderdate", total="o_totalprice")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(f"{c.removeprefix('status_')}_us")
    return r.select("o_custkey", "status", us("status_since"), "members", us("created"), us("updated"), F.round("total", 2).alias("total"))


@query("a09_status_histogram", "SELECT status, count(*) AS customers FROM (SELECT o_custkey, arg_min(o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 WHEN 'O' THEN 3 ELSE 4 END) AS status FROM orders GROUP BY o_custkey) GROUP BY status")
def _(s, d):
    return M.rollup(load(s, d, "orders"), ["o_custkey"], F.col("o_orderstatus"), _SEVERITY, "o_orderdate").groupBy("status").agg(F.count("*").alias("customers"))


@query("j19_u4_u5_merge_runs", f"WITH r AS {_ONCE}, last AS (SELECT case_id, query_mode, max_by(result_id, (run_idx, result_id)) AS result_id, count(*) AS runs FROM r GROUP BY ALL), cases AS (SELECT DISTINCT case_id FROM r), modes AS (SELECT DISTINCT query_mode FROM r) SELECT case_id, query_mode, result_id, runs FROM last UNION ALL SELECT case_id, query_mode, NULL, 0 FROM cases, modes WHERE (case_id, query_mode) NOT IN (SELECT (case_id, query_mode) FROM last)")
def _(s, d):
    r = results(s, d)
    last = r.groupBy("case_id", "query_mode").agg(F.max_by("result_id", F.struct("run_idx", "result_id")).alias("result_id"), F.count("*").alias("runs"))
    modes = [x[0] for x in r.select("query_mode").distinct().collect()]  # a handful of modes
    every = r.select("case_id").distinct().withColumn("query_mode", F.explode(F.array(*map(F.lit, modes))))
    missing = every.join(last, ["case_id", "query_mode"], "left_anti").select("case_id", "query_mode", F.lit(None).cast("bigint").alias("result_id"), F.lit(0).cast("bigint").alias("runs"))
    return last.unionByName(missing)


@query("w19_footer_grouping", f"SELECT result_id, r.file_path, count(*) AS hits, min(r.reference_id) AS first_id FROM {_ONCE}, unnest(cited_references) u(r) GROUP BY ALL")
def _(s, d):
    r = results(s, d).select("result_id", F.explode("cited_references").alias("r")).select("result_id", "r.*")
    return r.groupBy("result_id", "file_path").agg(F.count("*").alias("hits"), F.min("reference_id").alias("first_id"))


@query("w20_reference_numbers", "SELECT doc_id, CASE WHEN source IS NOT NULL THEN count(source) OVER (PARTITION BY full_doc_id ORDER BY chunk_order_index, doc_id) END AS reference_no FROM documents")
def _(s, d):
    w = Window.partitionBy("full_doc_id").orderBy("chunk_order_index", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return load(s, d, "documents").select("doc_id", F.when(F.col("source").isNotNull(), F.count("source").over(w)).alias("reference_no"))


_FIFO = """WITH e AS (SELECT event_id, event_type, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS t, greatest(value, 0) / 1000.0 AS v, ts FROM events WHERE ts IS NOT NULL AND value IS NOT NULL),
w AS (SELECT *, sum(v) OVER (PARTITION BY event_type, ts::DATE ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS work FROM e)
SELECT event_id, round(work + max(t - (work - v)) OVER (PARTITION BY event_type, ts::DATE ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) - t, 3) AS sojourn FROM w"""


@query("m01_fifo_replay", _FIFO)
def _(s, d):
    e = load(s, d, "events").where("ts is not null and value is not null").select("event_id", "event_type", F.to_date("ts").alias("day"), (F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6).alias("t"), (F.greatest("value", F.lit(0.0)) / 1000.0).alias("v"))
    return M.fifo(e, ["event_type", "day"], "t", "v", "event_id").select("event_id", F.round(F.col("end") - F.col("t"), 3).alias("sojourn"))


@query("m02_queue_positions", f"""{_FIFO[: _FIFO.index('SELECT event_id, round')].rstrip()},
f AS (SELECT event_id, event_type, ts::DATE AS day, t, work + max(t - (work - v)) OVER (PARTITION BY event_type, ts::DATE ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS e FROM w),
x AS (SELECT event_type, day, round(t, 6) AS moment, 1 AS delta, event_id FROM f UNION ALL SELECT event_type, day, round(e, 6), -1, event_id FROM f),
y AS (SELECT *, sum(delta) OVER (PARTITION BY event_type, day ORDER BY moment, delta, event_id ROWS UNBOUNDED PRECEDING) AS held FROM x)
SELECT event_id, CAST(held - 1 AS BIGINT) AS position FROM y WHERE delta = 1""")
def _(s, d):
    """How many requests stand before each on its arrival: 0 is served at once."""
    e = load(s, d, "events").where("ts is not null and value is not null").select("event_id", "event_type", F.to_date("ts").alias("day"), (F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6).alias("t"), (F.greatest("value", F.lit(0.0)) / 1000.0).alias("v"))
    return M.positions(M.fifo(e, ["event_type", "day"], "t", "v", "event_id"), ["event_type", "day"], "t", "end", "event_id")


@query("m02_queue_snapshot", "WITH x AS (SELECT event_type, date_trunc('hour', ts) AS hour, 1 AS delta FROM events UNION ALL SELECT event_type, date_trunc('hour', ts + INTERVAL 2 HOUR), -1 FROM events), h AS (SELECT event_type, hour, sum(delta) AS delta FROM x GROUP BY ALL) SELECT event_type, hour, CAST(sum(delta) OVER (PARTITION BY event_type ORDER BY hour) AS BIGINT) AS waiting FROM h")
def _(s, d):
    e = load(s, d, "events").select("event_type", F.explode(F.array(F.struct(F.date_trunc("hour", "ts").alias("hour"), F.lit(1).alias("delta")), F.struct(F.date_trunc("hour", F.expr("ts + interval 2 hours")).alias("hour"), F.lit(-1).alias("delta")))).alias("x")).select("event_type", "x.*")
    h = e.groupBy("event_type", "hour").agg(F.sum("delta").alias("delta"))  # pre-aggregated, so the window sees hours only
    return h.select("event_type", "hour", F.sum("delta").over(Window.partitionBy("event_type").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)).alias("waiting"))


@query("m03_ring_of_512", "SELECT event_id, event_type, value FROM events ORDER BY event_id DESC LIMIT 512")
def _(s, d):
    return load(s, d, "events").orderBy(F.desc("event_id")).limit(512).select("event_id", "event_type", "value")


@query("p17_incremental_scan", "SELECT event_id, event_type, value FROM events WHERE event_id > 5000")
def _(s, d):
    return load(s, d, "events").where("event_id > 5000").select("event_id", "event_type", "value")


@query("m07_stage_durations", "SELECT event_id, user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS since_us FROM events")
def _(s, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return load(s, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).select("event_id", "user_id", (F.col("us") - F.lag("us").over(w)).alias("since_us"))


@query("m08_timeline_once", "SELECT perf_id, epoch_us(min(started_at)) AS started_us, count(*) AS deliveries FROM vector_perf GROUP BY perf_id")
def _(s, d):
    return load(s, d, "vector_perf").groupBy("perf_id").agg(F.unix_micros(F.min("started_at")).alias("started_us"), F.count("*").alias("deliveries"))


@query("stream_windowed_latency", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS window_us, event_type, count(value) AS n, round(sum(value), 3) AS total, max(value) AS greatest FROM events GROUP BY ALL")
def _(s, d):
    st = SM.read_stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return SM.run_available(SM.windowed_latency(st, "ts", "event_type", "value", late="7 days"), ["window_start", "event_type"], "update").select(F.unix_micros("window_start").alias("window_us"), "event_type", "n", F.round("total", 3).alias("total"), "greatest")


@query("stream_once", "SELECT DISTINCT perf_id, kind FROM vector_perf WHERE started_at IS NOT NULL")
def _(s, d):
    st = SM.read_stream(s, d, "vector_perf").where("started_at is not null").select("perf_id", "kind", "started_at")
    return SM.run_available(SM.once_within(st, "perf_id", "started_at", "30 days")).select("perf_id", "kind")


@query("stream_admission")
def _(s, d):
    st = SM.read_stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return SM.run_available(SM.admission(st, "event_type", "ts", "value"))


# The star schema that comes with the project's tables: scans, joins and aggregates of a general kind.


@query("tpch_q1_pricing", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def _(s, d):
    l = load(s, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    return l.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("tpch_q5_by_region", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name")
def _(s, d):
    n = load(s, d, "nation").join(load(s, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = load(s, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    o = load(s, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name")
    return load(s, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
