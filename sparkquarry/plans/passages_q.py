"""Queries of passages, units and sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkquarry.functions import text as X
from sparkquarry.operators import lexical, pages, passages
from sparkquarry.plans import common as C
from sparkquarry.plans.retrieval_q import BM25_CTE, COS_CTE, best
from sparkquarry.sources import load

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


_HT = r"list_distinct(list_concat(list_filter(regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9_.+-]*'), lambda t: length(t) >= 2), flatten(list_transform(regexp_extract_all({0}, '[\x{{3400}}-\x{{9fff}}]+'), lambda t: list_transform(range(1, length(t)), lambda i: substring(t, i, 2))))))"


@query("w07_w08_best_sections", f"""WITH s AS (SELECT document_name AS doc, heading, heading_level AS level, block_index AS first_line, coalesce(content_template, '') AS body, count(*) OVER (PARTITION BY document_name) AS n FROM ir_blocks WHERE heading IS NOT NULL AND heading <> ''),
q AS (SELECT query_id, {_HT.format('query')} AS terms FROM ({C.QUESTIONS_SQL})),
z AS (SELECT query_id, doc, heading, level, first_line, 8 * len(list_filter(terms, lambda t: contains(lower(heading), t))) + least(len(list_filter(terms, lambda t: contains(lower(body), t))), 6) AS score FROM s, q WHERE n >= 2)
SELECT query_id, doc, heading, score FROM z WHERE score >= 8 QUALIFY row_number() OVER (PARTITION BY query_id, doc ORDER BY score DESC, level DESC, first_line, heading DESC) = 1""")
def _(s, d):
    b = load(s, d, "ir_blocks").where("heading is not null and heading <> ''").select(F.col("document_name").alias("doc"), "heading", F.col("heading_level").alias("level"), F.col("block_index").alias("first_line"), F.coalesce("content_template", F.lit("")).alias("body"))
    return passages.best_sections(b, C.questions(s, d)).withColumn("score", F.col("score").cast("bigint"))


@query("t17_evidence_units")
def units(s, d):
    return passages.evidence_units(C.markdown(s, d), "document_name", "markdown")


@query("t18_reconstruct")
def _(s, d):
    return passages.reconstruct(units(s, d), "document_name")


@query("w17_t22_t23_t25_passages")
def _(s, d):
    q = C.expanded(C.questions(s, d))
    return passages.best_passages(best(s, d, 6), C.chunks(s, d), q)


@query("w18_token_fit", r"""WITH n AS (SELECT doc_id, text, i, sum(CASE WHEN unicode(substring(text, i, 1)) < 128 THEN 0.25 ELSE 1.0 END) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM documents, unnest(range(1, length(text) + 1)) u(i) WHERE text IS NOT NULL),
k AS (SELECT doc_id, max(i) FILTER (WHERE upto <= 100) AS fits FROM n GROUP BY doc_id) SELECT doc_id, md5(substring(text, 1, coalesce(fits, 0))) AS digest FROM documents LEFT JOIN k USING (doc_id) WHERE text IS NOT NULL""")
def _(s, d):
    t = load(s, d, "documents").where("text is not null")
    return t.select("doc_id", F.md5(passages.fit_tokens("text", F.lit(100)).cast("binary")).alias("digest"))


@query("t24_table_passages", r"""WITH r AS (SELECT t.table_uid, i, lower(regexp_replace(x[i], '<[^>]*>', ' ', 'g')) AS line, length(x[i]) AS n, lower(coalesce(b.heading, '')) AS h FROM (SELECT table_uid, ir_block_id, regexp_extract_all(html, '(?is)<tr.*?</tr>') AS x FROM ir_tables WHERE html IS NOT NULL) t JOIN ir_blocks b USING (ir_block_id), unnest(range(1, len(x) + 1)) u(i)),
s AS (SELECT *, len(list_filter(list_distinct(regexp_extract_all(h, '[a-z0-9]{3,}')), lambda w: contains(line, w))) AS score FROM r),
g AS (SELECT *, sum(n) OVER (PARTITION BY table_uid ORDER BY score DESC, i ROWS UNBOUNDED PRECEDING) AS upto FROM s)
SELECT table_uid, string_agg(i - 1, ',' ORDER BY i) AS rows FROM g WHERE upto <= 200 GROUP BY table_uid""")
def _(s, d):
    from pyspark.sql import Window

    t = load(s, d, "ir_tables").where("html is not null").select("table_uid", "ir_block_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?is)<tr.*?</tr>"), F.lit(0))).alias("i", "row"))
    r = t.join(load(s, d, "ir_blocks").select("ir_block_id", F.lower(F.coalesce("heading", F.lit(""))).alias("h")), "ir_block_id")
    line = F.lower(F.regexp_replace("row", "<[^>]*>", " "))
    r = r.withColumn("score", F.size(F.filter(F.array_distinct(F.regexp_extract_all("h", F.lit("[a-z0-9]{3,}"), F.lit(0))), lambda w: F.contains(line, w))))
    w = Window.partitionBy("table_uid").orderBy(F.desc("score"), "i").rowsBetween(Window.unboundedPreceding, 0)
    kept = r.withColumn("upto", F.sum(F.char_length("row")).over(w)).where("upto <= 200")
    return kept.groupBy("table_uid").agg(F.array_join(F.array_sort(F.collect_list("i")), ",").alias("rows"))


@query("t30_t31_page_blocks")
def _(s, d):
    p = load(s, d, "parsed_pages").select("page_uid", F.col("document_id").alias("document"), "page")
    return pages.page_blocks(load(s, d, "blocks").join(p, "page_uid").where("document is not null"))


_W = passages.CONTRACT_WORDS
_KIND = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(query), '{w}')" for w in _W[k]) + f" THEN '{k}'" for k in _W) + " ELSE 'general' END"
_EVERY = r"list_distinct(regexp_extract_all(lower(query), '(?:^|[^\p{{L}}\p{{N}}\p{{M}}\p{{Pc}}])({})', 1))"
_MODELS, _TOKENS = _EVERY.format("(?:" + "|".join(passages.MODEL_NAMES) + ")[a-z0-9._-]*[a-z0-9_]"), _EVERY.format("[a-z](?:[a-z0-9._+-]*[a-z0-9_])?")
_THINGS = f"CASE WHEN len({_MODELS}) >= 2 THEN {_MODELS} ELSE list_filter({_TOKENS}, lambda t: regexp_matches(t, '[0-9]')) END"
_ANCHORS = _EVERY.format("[a-z][a-z0-9_.+-]+[a-z0-9_]")
#: Whether ``content`` meets the contract of ``query``, of kind ``kind``.
_MET = rf"""coalesce(CASE kind WHEN 'comparison' THEN len({_THINGS}) >= 2 AND len(list_filter({_THINGS}, lambda t: NOT contains(lower(content), t))) = 0 WHEN 'command' THEN regexp_matches(content, '`[^`]+`|[A-Za-z]')
WHEN 'procedure' THEN (len({_ANCHORS}) = 0 OR len(list_filter({_ANCHORS}, lambda t: contains(lower(content), t))) > 0) AND (len(regexp_extract_all(content, '(?m)^\s*(?:[-*+]\s+|\d+[.)]\s+)')) >= 2 OR contains(content, '然后') OR len(string_split(content, '→')) >= 3) ELSE TRUE END, FALSE)"""


@query("p05_evidence_contract", f"SELECT DISTINCT result_id, kind, CASE WHEN {_MET} THEN 'pass' ELSE 'needs_retrieval' END AS status FROM (SELECT result_id, question AS query, answer AS content, {_KIND.replace('query', 'question')} AS kind FROM eval_results WHERE question IS NOT NULL)")
def _(s, d):
    kind, status = passages.evidence_contract(F.col("question"), F.col("answer"))
    return load(s, d, "eval_results").where("question is not null").select("result_id", kind.alias("kind"), status.alias("status")).distinct()


#: The questions with what a recovery adds to them, by kind.
_MORE = "query || CASE " + _KIND[5:].replace("THEN 'comparison'", f"THEN '{passages.RECOVERY_WORDS['comparison']}'").replace("THEN 'command'", f"THEN '{passages.RECOVERY_WORDS['command']}'").replace("THEN 'procedure'", f"THEN '{passages.RECOVERY_WORDS['procedure']}'").replace("ELSE 'general'", "ELSE ''")
_RECOVERY_CTE = BM25_CTE.replace(C.EXPANDED_SQL, C.EXPANDED_SQL.replace("query", f"({_MORE})")) if C.EXPANDED_SQL in BM25_CTE else ""


@query("j07_u2_contract_recovery", f"""WITH {COS_CTE}, {_RECOVERY_CTE}, k AS (SELECT query_id, query, {_KIND} AS kind FROM ({C.QUESTIONS_SQL})),
ca AS (SELECT query_id, chunk_id FROM cos WHERE rank <= 3), fo AS (SELECT query_id, chunk_id FROM lex WHERE rank <= 3),
met AS (SELECT DISTINCT query_id FROM ca JOIN k USING (query_id) JOIN ch USING (chunk_id) WHERE {_MET}),
more AS (SELECT fo.* FROM fo JOIN k USING (query_id) JOIN ch USING (chunk_id) WHERE {_MET} AND query_id NOT IN (SELECT query_id FROM met))
SELECT query_id, chunk_id, FALSE AS supplemental FROM ca UNION ALL SELECT query_id, chunk_id, TRUE FROM more ANTI JOIN ca USING (query_id, chunk_id)""")
def _(s, d):
    """The three nearest chunks; where none meets the question's contract, the best ones by BM25 for the question with words of its kind."""
    q, chunks = C.questions(s, d), C.chunks(s, d)
    kind = passages.evidence_contract(F.col("query"), F.lit(""))[0]
    words = F.create_map(*(F.lit(x) for kv in passages.RECOVERY_WORDS.items() for x in kv))
    more = C.expanded(q.withColumn("query", F.concat("query", F.coalesce(words[kind], F.lit("")))))
    text = chunks.select("chunk_id", "content")
    candidates = lexical.cosine(chunks, q, 3).select("query_id", "chunk_id").join(text, "chunk_id")
    return passages.recover(candidates, q, lexical.bm25(chunks, more, 3).select("query_id", "chunk_id").join(text, "chunk_id"))


@query("m05_progressing_pages", "WITH p AS (SELECT DISTINCT page_uid AS chunk, reading_order AS page_no, label || ':' || text_source AS key FROM blocks), f AS (SELECT chunk, key, min(page_no) AS page_no FROM p GROUP BY ALL), n AS (SELECT chunk, page_no, count(*) AS k FROM f GROUP BY ALL), e AS (SELECT DISTINCT chunk, page_no FROM p) SELECT chunk, page_no, coalesce(k, 0) AS new_keys, min(coalesce(k, 0)) OVER (PARTITION BY chunk ORDER BY page_no) > 0 AS kept FROM e LEFT JOIN n USING (chunk, page_no)")
def _(s, d):
    b = load(s, d, "blocks").select(F.col("page_uid").alias("chunk"), F.col("reading_order").alias("page_no"), F.concat("label", F.lit(":"), "text_source").alias("key"))
    return passages.progressing_pages(b)


@query("t27_table_locations", "SELECT b.document_name, string_agg(DISTINCT t.placeholder_key, ', ' ORDER BY t.placeholder_key) AS tables, count(DISTINCT t.table_uid) AS n FROM ir_tables t JOIN ir_blocks b USING (ir_block_id) GROUP BY b.document_name")
def _(s, d):
    t = load(s, d, "ir_tables").join(load(s, d, "ir_blocks").select("ir_block_id", "document_name"), "ir_block_id")
    return t.groupBy("document_name").agg(F.array_join(F.array_sort(F.collect_set("placeholder_key")), ", ").alias("tables"), F.countDistinct("table_uid").alias("n"))


@query("p13_p14_score_and_text_filters", "SELECT ocr_id FROM ocr_texts WHERE rec_score >= 0.9 AND length(trim(text, ' ')) > 0")
def _(s, d):
    return load(s, d, "ocr_texts").where("rec_score >= 0.9 and length(trim(text)) > 0").select("ocr_id")


@query("u3_term_set_algebra", f"SELECT result_id, len(list_intersect(q, a)) AS common, len(q) > 0 AND len(list_filter(q, lambda t: NOT list_contains(a, t))) = 0 AS covered FROM (SELECT DISTINCT result_id, {_HT.format('question')} AS q, {_HT.format('answer')} AS a FROM eval_results WHERE question IS NOT NULL AND answer IS NOT NULL)")
def _(s, d):
    e = load(s, d, "eval_results").where("question is not null and answer is not null").select("result_id", X.heading_terms(F.col("question")).alias("q"), X.heading_terms(F.col("answer")).alias("a")).distinct()
    return e.select("result_id", F.size(F.array_intersect("q", "a")).cast("bigint").alias("common"), ((F.size("q") > 0) & (F.size(F.array_except("q", "a")) == 0)).alias("covered"))


@query("t20_numbered_items", r"SELECT doc_id, len(x) AS items, list_max(list_transform(x, lambda l: length(l))) AS longest FROM (SELECT doc_id, regexp_extract_all(text, '(?m)^\s*\d+[.)]\s+[^\n]+') AS x FROM documents) WHERE len(x) >= 2")
def _(s, d):
    items = F.regexp_extract_all("text", F.lit(r"(?md)^\s*\d+[.)]\s+[^\n]+"), F.lit(0))
    t = load(s, d, "documents").select("doc_id", items.alias("x")).where(F.size("x") >= 2)
    return t.select("doc_id", F.size("x").cast("bigint").alias("items"), F.array_max(F.transform("x", lambda l: F.char_length(l))).cast("bigint").alias("longest"))


