"""Queries of gates, sinks and caches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkquarry.functions import text as T
from sparkquarry.operators import evidence, fusion, gates, markdown, metrics, tables
from sparkquarry.plans import common as C
from sparkquarry.plans.functions_q import IDENTIFIERS_SQL, PROFILE_SQL
from sparkquarry.plans.retrieval_q import BM25_CTE, best
from sparkquarry.plans.structure_q import _ROWS
from sparkquarry.sources import load
from sparkquarry.sources.sinks import write_lines, write_routed
from sparkquarry.streaming.metrics import shared_folder

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


@query("w06_p18_protected_evidence", rf"""WITH {BM25_CTE}, q AS (SELECT query_id, {PROFILE_SQL} AS profile, {IDENTIFIERS_SQL.replace('(l,', '(lower(query),')} AS ids FROM ({C.QUESTIONS_SQL})),
c AS (SELECT query_id, chunk_id, profile, rank, len(list_filter(ids, lambda i: contains(lower(regexp_replace(content, '\s+', ' ', 'g')), i))) AS covered, length(regexp_replace(regexp_replace(regexp_replace(content, '(?s)<!--.*?-->', '', 'g'), '(?m)^[{C.SPACES}]{{0,3}}#{{1,6}}[{C.SPACES}].*$', '', 'g'), '^[{C.SPACES}]+|[{C.SPACES}]+$', '', 'g')) >= 24 AS solid FROM lex JOIN q USING (query_id) JOIN ({C.CHUNKS_SQL}) x USING (chunk_id) WHERE rank <= 12 AND profile IN ('document_fact', 'exact', 'table', 'relation_fact')),
g AS (SELECT query_id, profile, min(CASE WHEN solid THEN (rank, chunk_id) END) AS fact, min(CASE WHEN covered > 0 THEN (-covered, rank, rank, chunk_id) END) AS named, min(CASE WHEN solid THEN (rank, chunk_id) END) AS lexical FROM c GROUP BY ALL)
SELECT query_id, CASE WHEN profile = 'document_fact' THEN fact[2] WHEN named IS NOT NULL THEN named[4] ELSE lexical[2] END AS chunk_id, CASE WHEN profile = 'document_fact' THEN 'fact' WHEN named IS NOT NULL THEN 'named' ELSE 'lexical' END AS why FROM g WHERE chunk_id IS NOT NULL""")
def _(s, d):
    q = C.questions(s, d)
    top = best(s, d).select("query_id", "chunk_id", "rank", F.col("rank").alias("lexical_rank"))
    return gates.protected_evidence(top.join(C.chunks(s, d).select("chunk_id", "content"), "chunk_id"), q)


@query("p02_p03_graph_budget", f"SELECT query_id, CASE WHEN profile IN ('exact', 'document_fact') THEN 0 ELSE 500 END AS entity_tokens, CASE WHEN profile IN ('exact', 'document_fact') THEN 0 ELSE 300 END AS relation_tokens, profile <> 'relation_fact' AS graph FROM (SELECT query_id, {PROFILE_SQL} AS profile FROM ({C.QUESTIONS_SQL}))")
def _(s, d):
    p = fusion.profiled(C.questions(s, d))
    off = F.col("profile").isin("exact", "document_fact")
    return p.select("query_id", F.when(off, 0).otherwise(500).alias("entity_tokens"), F.when(off, 0).otherwise(300).alias("relation_tokens"), (F.col("profile") != "relation_fact").alias("graph"))


_FLAGS = f"(SELECT b.document_name AS query_id, t.table_uid, coalesce(regexp_matches(t.html, '(?i)<tr'), FALSE) AS typed, coalesce(len(list_filter({_ROWS}, lambda r: len(r) <> len({_ROWS}[1]))) = 0, FALSE) AS passed FROM ir_tables t JOIN ir_blocks b USING (ir_block_id))"


def _flags(s, d):
    t = load(s, d, "ir_tables").join(load(s, d, "ir_blocks").select("ir_block_id", F.col("document_name").alias("query_id")), "ir_block_id")
    rows = tables.html_rows(F.col("html"))
    return t.select("query_id", "table_uid", F.coalesce(F.col("html").rlike("(?i)<tr"), F.lit(False)).alias("typed"), F.coalesce(F.size(tables.rectangular(rows)) == F.size(rows), F.lit(False)).alias("passed"))


@query("p06_coverage_gate", f"SELECT query_id, table_uid FROM (SELECT *, max(typed AND passed) OVER (PARTITION BY query_id) AS any_ok FROM {_FLAGS}) WHERE CASE WHEN any_ok THEN typed AND passed ELSE NOT (typed AND NOT passed) END")
def _(s, d):
    return gates.coverage_gate(_flags(s, d), "typed", "passed").select("query_id", "table_uid")


@query("p12_keep_if_any", f"SELECT query_id, table_uid FROM (SELECT *, max(passed) OVER (PARTITION BY query_id) AS any_ok FROM {_FLAGS}) WHERE passed OR NOT any_ok")
def _(s, d):
    return gates.keep_if_any(_flags(s, d), "passed").select("query_id", "table_uid")


@query("t16_expand_rows", f"""WITH r AS (SELECT t.table_uid, i, rs[1] AS head, rs[i] AS cells, contains(lower(b.content_template), lower(rs[i][1])) AND length(rs[i][1]) >= 2 AS named FROM (SELECT table_uid, ir_block_id, {_ROWS} AS rs FROM ir_tables WHERE regexp_matches(html, '(?i)<tr')) t JOIN ir_blocks b USING (ir_block_id), unnest(range(2, len(rs) + 1)) u(i) WHERE len(rs[i]) = len(rs[1])),
k AS (SELECT * FROM (SELECT *, max(coalesce(named, FALSE)) OVER (PARTITION BY table_uid) AS any_named FROM r) WHERE coalesce(named, FALSE) OR NOT any_named)
SELECT table_uid, count(*) AS n, md5(string_agg(array_to_string(list_transform(range(1, len(head) + 1), lambda j: '- ' || head[j] || ' = ' || cells[j]), chr(10)), chr(10) ORDER BY i)) AS digest FROM k GROUP BY table_uid""")
def _(s, d):
    t = load(s, d, "ir_tables").where(F.col("html").rlike("(?i)<tr")).select("table_uid", "ir_block_id", tables.html_rows(F.col("html")).alias("rows"))
    r = t.select("table_uid", "ir_block_id", F.get("rows", F.lit(0)).alias("head"), F.posexplode("rows").alias("i", "cells")).where((F.col("i") > 0) & (F.size("cells") == F.size("head")))
    h = load(s, d, "ir_blocks").select("ir_block_id", F.lower("content_template").alias("h"))
    key = F.get("cells", F.lit(0))
    r = r.join(h, "ir_block_id").withColumn("named", F.contains("h", F.lower(key)) & (F.char_length(key) >= 2))
    lines = F.array_join(F.zip_with("head", "cells", lambda a, b: F.concat(F.lit("- "), a, F.lit(" = "), b)), "\n")
    k = gates.keep_if_any(r, "named", "table_uid").select("table_uid", "i", lines.alias("l"))
    g = k.groupBy("table_uid").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("i", "l"))).alias("ls"))
    return g.select("table_uid", "n", F.md5(F.array_join(F.transform("ls", lambda x: x["l"]), "\n").cast("binary")).alias("digest"))


@query("a07_best_of_family", f"WITH {BM25_CTE} SELECT query_id, regexp_replace(file_path, '\\.(kg|text)\\.md$', '.md') AS family, round(max(score), 5) AS best, count(*) AS n FROM lex JOIN ({C.CHUNKS_SQL}) c USING (chunk_id) WHERE rank <= 12 AND file_path IS NOT NULL GROUP BY ALL")
def _(s, d):
    top = best(s, d).join(C.chunks(s, d).where("file_path is not null").select("chunk_id", T.source_family(F.col("file_path")).alias("family")), "chunk_id")
    return top.groupBy("query_id", "family").agg(F.round(F.max("score"), 5).alias("best"), F.count("*").alias("n"))


@query("m09_answer_cache", "SELECT question, query_model, max_by(result_id, (started_at, result_id)) AS result_id, count(DISTINCT result_id) AS answers FROM eval_results WHERE answer IS NOT NULL AND started_at IS NOT NULL GROUP BY ALL")
def _(s, d):
    e = load(s, d, "eval_results").where("answer is not null and started_at is not null")
    return e.groupBy("question", "query_model").agg(F.max_by("result_id", F.struct("started_at", "result_id")).alias("result_id"), F.countDistinct("result_id").alias("answers"))


@query("s06_routed_sink")
def _(s, d):
    b = markdown.blocks(C.markdown(s, d), "document_name", "markdown")
    path = f"{shared_folder(s)}/routed"
    write_routed(b, path)
    return s.read.schema(b.schema).parquet(path).groupBy("kind", "reason").agg(F.count("*").alias("n"))


@query("s11_s12_result_lines", "SELECT query_model, count(*) AS n, count(answer) AS answered FROM (SELECT DISTINCT result_id, query_model, answer FROM eval_results) GROUP BY query_model")
def _(s, d):
    path = f"{shared_folder(s)}/lines"
    write_lines(metrics.last_run(load(s, d, "eval_results"), ["result_id"], F.col("received_at")).select("result_id", "query_model", "answer"), path)
    back = s.read.schema("result_id bigint, query_model string, answer string").json(path)
    return back.groupBy("query_model").agg(F.count("*").alias("n"), F.count("answer").alias("answered"))


_PARENTS = r"""SELECT ir_block_id || '-table-' || lpad(CAST(row_number() OVER (PARTITION BY ir_block_id ORDER BY n) AS VARCHAR), 2, '0') AS table_id, 'text' AS origin FROM (
SELECT ir_block_id, n FROM (SELECT ir_block_id, i AS n, l[i] AS line, CASE WHEN i > 1 THEN l[i - 1] END AS prior, CASE WHEN i < len(l) THEN l[i + 1] END AS following FROM (SELECT ir_block_id, string_split(content_template, chr(10)) AS l FROM ir_blocks WHERE content_template IS NOT NULL), unnest(range(1, len(l) + 1)) u(i))
WHERE regexp_matches(line, '^\s*\|.*\|\s*$') AND regexp_matches(coalesce(following, ''), '^\s*\|.*\|\s*$') AND NOT regexp_matches(coalesce(prior, ''), '^\s*\|.*\|\s*$'))"""


@query("s05_j06_table_index", f"WITH p AS ({_PARENTS}), s AS (SELECT ir_block_id || '-table-' || lpad(regexp_extract(placeholder_key, '[0-9]+'), 2, '0') AS table_id, 'sidecar' AS origin FROM ir_tables) SELECT table_id, origin FROM p UNION ALL SELECT s.* FROM s ANTI JOIN p USING (table_id)")
def _(s, d):
    """Tables in the texts of blocks, and those of the sidecar that aren't among them."""
    lines = F.split("content_template", "\n")
    piped = lambda x: F.coalesce(x, F.lit("")).rlike(r"^\s*\|.*\|\s*$")
    b = load(s, d, "ir_blocks").where("content_template is not null").select("ir_block_id", F.filter(F.transform(lines, lambda x, i: F.when(piped(x) & piped(F.get(lines, i + 1)) & ~piped(F.get(lines, i - 1)), i)), lambda x: x.isNotNull()).alias("starts"))
    parents = b.select("ir_block_id", F.posexplode("starts").alias("no", "start")).select(F.concat("ir_block_id", F.lit("-table-"), F.lpad((F.col("no") + 1).cast("string"), 2, "0")).alias("table_id"), F.lit("text").alias("origin"))
    sidecar = load(s, d, "ir_tables").select(F.concat("ir_block_id", F.lit("-table-"), F.lpad(F.regexp_extract("placeholder_key", "[0-9]+", 0), 2, "0")).alias("table_id"), F.lit("sidecar").alias("origin"))
    return tables.parent_index(parents, sidecar)


_QUOTES = r"SELECT DISTINCT r.file_path AS source, unnest(list_distinct(regexp_extract_all(lower(question), '[a-z]{3,} [a-z]{3,}'))) AS quote FROM eval_results, unnest(cited_references) u(r) WHERE question IS NOT NULL AND r.file_path IS NOT NULL"


@query("j10_quotes_in_sources", f"SELECT source, quote FROM ({_QUOTES}) q WHERE EXISTS (SELECT 1 FROM documents t WHERE t.source = q.source AND contains(lower(t.text), quote))")
def _(s, d):
    """Pairs of words of a question that a cited source holds."""
    pairs = F.array_distinct(F.regexp_extract_all(F.lower("question"), F.lit("[a-z]{3,} [a-z]{3,}"), F.lit(0)))
    e = load(s, d, "eval_results").where("question is not null").select(F.explode("cited_references").alias("r"), pairs.alias("q"))
    quotes = e.select(F.col("r.file_path").alias("source"), F.explode("q").alias("quote")).where("source is not null")
    return evidence.quotes_in_sources(quotes, load(s, d, "documents").select("source", "text"))


@query("j18_first_location", r"""WITH c AS (SELECT source, min((chunk_order_index, doc_id)) AS k FROM documents WHERE source IS NOT NULL AND regexp_matches(text, '(?m)^[ \t]*\|[^\n]*\|[ \t]*$') GROUP BY source)
SELECT DISTINCT result_id, r.reference_id, k[2] AS chunk_id, array_to_string(list_filter(content_headings, lambda h: trim(h, ' ') <> ''), ' > ') AS location FROM eval_results, unnest(cited_references) u(r) LEFT JOIN c ON c.source = r.file_path LEFT JOIN documents ON doc_id = k[2]""")
def _(s, d):
    """Of each reference the first chunk of its source that has a table, and where that stands. The first chunks are found by source before references join, so no source's chunks meet its references."""
    docs = load(s, d, "documents").where("source is not null").where(F.col("text").rlike(r"(?md)^[ \t]*\|[^\n]*\|[ \t]*$"))
    where = F.array_join(F.filter("content_headings", lambda h: F.trim(h) != ""), " > ")
    first = docs.groupBy("source").agg(F.min_by(F.struct(F.col("doc_id").alias("chunk_id"), where.alias("location")), F.struct("chunk_order_index", "doc_id")).alias("c"))
    refs = load(s, d, "eval_results").select("result_id", F.explode("cited_references").alias("r")).select("result_id", "r.reference_id", F.col("r.file_path").alias("source")).distinct()
    return refs.join(first, "source", "left").select("result_id", "reference_id", "c.chunk_id", "c.location").distinct()


_DIAGNOSTIC = "错误|故障|失败|异常|error|fail"


@query("p11_p12_source_policy", rf"""WITH {BM25_CTE}, t AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS most FROM lex WHERE rank <= 12),
f AS (SELECT query_id, chunk_id, rank, score / most AS s0, file_path, regexp_replace(file_path, '\.(kg|text)\.md$', '.md') AS family, content, pr = 'relation_fact' AS relation, regexp_matches(lower(query), '{_DIAGNOSTIC}') AS diagnostic,
 pr = 'table' AND regexp_matches(content, '(?i)<table') AS parent, len(list_filter(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]{{3,}}')), lambda w: contains(lower(coalesce(array_to_string(content_headings, ' '), '')), w))) AS named, rank = 1 AND pr IN ('exact', 'document_fact') AS protected,
 len(list_filter([{', '.join(f"'{b}'" for _, b in C.EXPANSIONS)}], lambda x: contains(lower(content), x))) AS hits, pr = 'table' AND regexp_matches(content, '(?m)^[ 	]*\|[^
]*\|[ 	]*$') AS tab FROM t JOIN ch USING (chunk_id) JOIN (SELECT query_id, query, {PROFILE_SQL} AS pr FROM ({C.QUESTIONS_SQL})) USING (query_id)),
a0 AS (SELECT *, s0 * (CASE WHEN file_path LIKE '%release%' THEN 0.2 ELSE 1.0 END) * (CASE WHEN length(content) < 160 AND NOT contains(content, '--') AND NOT contains(content, '/') THEN 0.25 ELSE 1.0 END) * (CASE WHEN hits >= 2 THEN 1 + 0.4 * least(hits, 3) ELSE 1.0 END) * (CASE WHEN tab THEN 1.5 ELSE 1.0 END) AS score FROM f),
a1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, rank) AS n, max(parent) OVER (PARTITION BY query_id) AS done1 FROM a0),
a2 AS (SELECT *, max(named) OVER (PARTITION BY query_id) AS mn FROM a1 WHERE parent OR NOT done1), a3 AS (SELECT *, max(protected AND NOT done1 AND NOT relation) OVER (PARTITION BY query_id) AS anyp FROM a2 WHERE done1 OR relation OR mn < 1 OR named = mn OR (protected AND hits >= 2)),
a4 AS (SELECT *, max(tab AND NOT done1) OVER (PARTITION BY query_id) AS anyt, max(tab) OVER (PARTITION BY query_id) AS anytab FROM a3 WHERE NOT anyp OR protected), a5 AS (SELECT *, diagnostic AND NOT done1 AND NOT anytab AS asked, coalesce(file_path LIKE '%.kg.md' AND max(file_path LIKE '%.text.md') OVER (PARTITION BY query_id, family), FALSE) AS beside FROM a4 WHERE NOT anyt OR tab),
a6 AS (SELECT *, max(asked AND NOT beside) OVER (PARTITION BY query_id) AS anyb FROM a5), a7 AS (SELECT *, first_value(score) OVER (PARTITION BY query_id ORDER BY n) AS top FROM a6 WHERE NOT anyb OR (asked AND NOT beside)),
a8 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n) AS m FROM a7 WHERE NOT asked OR top < 0.5 OR score >= 0.3 * top) SELECT query_id, chunk_id, round(score, 5) AS score, m AS final_rank FROM a8 WHERE NOT asked OR top < 0.5 OR m <= 2""")
def _(s, d):
    """The source policy over the best twelve chunks of each question; their scores, for want of a reranking model, are BM25's as a share of the best."""
    q = fusion.profiled(C.questions(s, d)).select("query_id", "query", "profile")
    top = best(s, d).withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy("query_id")))
    r = top.join(C.chunks(s, d).select("chunk_id", "content", "file_path", "content_headings"), "chunk_id").join(q, "query_id")
    low, heads = F.lower("content"), F.lower(F.coalesce(F.array_join("content_headings", " "), F.lit("")))
    words = F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit("[a-z0-9]{3,}"), F.lit(0)))
    is_table = F.col("profile") == "table"
    r = r.withColumns({
        "family": T.source_family(F.col("file_path")), "relation": F.col("profile") == "relation_fact", "diagnostic": F.lower("query").rlike(_DIAGNOSTIC), "parent": is_table & F.col("content").rlike("(?i)<table"), "named": F.size(F.filter(words, lambda w: F.contains(heads, w))),
        "protected": (F.col("rank") == 1) & F.col("profile").isin("exact", "document_fact"), "hits": F.size(F.filter(F.array(*(F.lit(b) for _, b in C.EXPANSIONS)), lambda x: F.contains(low, x))), "table": is_table & F.col("content").rlike(r"(?md)^[ \t]*\|[^\n]*\|[ \t]*$"),
    })
    return evidence.authority(r, "%release%").withColumn("score", F.round("score", 5))
