"""Queries of the column functions (F rows of the survey), over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkquarry.functions import boxes as X
from sparkquarry.functions import text as T
from sparkquarry.operators import evidence, passages
from sparkquarry.plans import common as C
from sparkquarry.plans.tokens_sql import TERM, contains_any, passage_terms, terms
from sparkquarry.sources import load

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


ALL_Q = "(SELECT DISTINCT question AS query FROM eval_results WHERE question IS NOT NULL)"
DIGEST = "md5(array_to_string({}, ' '))"


@query("f01_compact_identifier", "SELECT DISTINCT source, regexp_replace(lower(source), '[^a-z0-9]+', '', 'g') AS compact FROM documents")
def _(s, d):
    return load(s, d, "documents").select("source").distinct().select("source", T.compact_identifier(F.col("source")).alias("compact"))


@query("f02_terms", f"SELECT chunk_id, len(ts) AS n_terms, {DIGEST.format('ts')} AS digest FROM (SELECT chunk_id, {terms('content')} AS ts FROM ({C.CHUNKS_SQL}))")
def _(s, d):
    return C.chunks(s, d).select("chunk_id", T.terms(F.col("content")).alias("ts")).select("chunk_id", F.size("ts").cast("bigint").alias("n_terms"), F.md5(F.array_join("ts", " ").cast("binary")).alias("digest"))


@query("f03_passage_terms", f"SELECT chunk_id, len(ts) AS n_terms, {DIGEST.format('ts')} AS digest FROM (SELECT chunk_id, {passage_terms('content')} AS ts FROM ({C.CHUNKS_SQL}))")
def _(s, d):
    return C.chunks(s, d).select("chunk_id", T.passage_terms(F.col("content")).alias("ts")).select("chunk_id", F.size("ts").cast("bigint").alias("n_terms"), F.md5(F.array_join("ts", " ").cast("binary")).alias("digest"))


@query("f04_index_text", f"SELECT chunk_id, md5({C.INDEX_SQL}) AS digest FROM ({C.CHUNKS_SQL})")
def _(s, d):
    return C.chunks(s, d).select("chunk_id", F.md5(T.index_text(F.col("content")).cast("binary")).alias("digest"))


_SHAPE = rf"(regexp_matches(query, '{T.COMPOSITE}') OR regexp_matches(query, '(?i)\b{T.VERSION}\b') OR regexp_matches(query, '{T.FLAG}') OR regexp_matches(query, '(?i)\b{T.HEX}\b') OR regexp_matches(query, '(?i)\b{T.NAMED_NUMBER}\b'))"
_PHRASE = rf"(?:^|[^\p{{L}}\p{{N}}\p{{M}}\p{{Pc}}])({T.PHRASE})"
_LEFT, _RIGHT = (lambda m: f"lower(list_extract(regexp_extract_all(split_part(query, '{m}', 1), '{_PHRASE}', 1), -1))"), (lambda m: f"lower(nullif(regexp_extract(substring(query, instr(query, '{m}') + {len(m)}), '{_PHRASE}', 1), ''))")
#: Whether some marker has different phrases on both sides.
_RELATION = "(" + " OR ".join(f"coalesce(contains(query, '{m}') AND {_LEFT(m)} <> {_RIGHT(m)}, FALSE)" for m in T.RELATION_MARKERS) + ")"
PROFILE_SQL = f"""CASE WHEN {contains_any('query', T.TABLE_WORDS)} THEN 'table' WHEN {_RELATION} THEN 'relation_fact' WHEN {contains_any('query', T.FACT_WORDS)} THEN 'document_fact'
  WHEN {_SHAPE} AND ({contains_any('query', T.EXACT_WORDS)} OR length(trim(query)) <= 48) THEN 'exact' WHEN {contains_any('query', T.SEMANTIC_WORDS)} THEN 'semantic' ELSE 'balanced' END"""


@query("f05_retrieval_profile", f"SELECT query, {PROFILE_SQL} AS profile FROM {ALL_Q}")
def _(s, d):
    return C.all_questions(s, d).select("query", T.retrieval_profile(F.col("query")).alias("profile"))


@query("f07_query_expansion", f"SELECT query, {C.EXPANDED_SQL} AS expanded FROM {ALL_Q}")
def _(s, d):
    return C.expanded(C.all_questions(s, d)).select("query", "expanded")


_ANCHORS_SQL = "CASE " + " ".join(f"WHEN contains(query, '{m}') AND {_LEFT(m)} <> {_RIGHT(m)} THEN [{_LEFT(m)}, {_RIGHT(m)}]" for m in T.RELATION_MARKERS) + " END"


@query("f08_relation_anchors", f"SELECT query, a[1] AS left_anchor, a[2] AS right_anchor FROM (SELECT query, {_ANCHORS_SQL} AS a FROM {ALL_Q})")
def _(s, d):
    a = T.relation_anchors(F.col("query"))
    return C.all_questions(s, d).select("query", F.get(a, F.lit(0)).alias("left_anchor"), F.get(a, F.lit(1)).alias("right_anchor"))


@query("f09_anchor_coverage", r"SELECT chunk_id, len(list_filter(['calibration table', 'status indicator', 'message queue'], lambda a: contains(lower(regexp_replace(content, '\s+', ' ', 'g')), a))) AS matched FROM (" + C.CHUNKS_SQL + ")")
def _(s, d):
    anchors = F.array(F.lit("calibration table"), F.lit("status indicator"), F.lit("message queue"))
    return C.chunks(s, d).select("chunk_id", F.size(T.coverage(anchors, F.col("content"))).cast("bigint").alias("matched"))


@query("f10_tightest_span", r"""WITH t AS (SELECT doc_id AS chunk_id, lower(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents WHERE contains(lower(regexp_replace(text, '\s+', ' ', 'g')), 'gateway module') AND contains(lower(regexp_replace(text, '\s+', ' ', 'g')), 'power supply')),
p AS (SELECT chunk_id, i, substring(c, i, 14) = 'gateway module' AS a, substring(c, i, 12) = 'power supply' AS b FROM t, unnest(range(1, length(c) + 1)) u(i))
SELECT x.chunk_id, min(abs(x.i - y.i)) AS span FROM p x JOIN p y ON x.chunk_id = y.chunk_id AND x.a AND y.b GROUP BY x.chunk_id""")
def _(s, d):
    both = C.chunks(s, d).withColumn("c", F.lower(F.regexp_replace("content", r"\s+", " "))).where("contains(c, 'gateway module') and contains(c, 'power supply')")
    return both.select("chunk_id", T.tightest_span(F.lit("gateway module"), F.lit("power supply"), "content").alias("span"))


@query("f11_direct_relation", r"SELECT chunk_id, contains(c, 'message queue') AND contains(c, 'network bridge') AS both_there FROM (SELECT doc_id AS chunk_id, lower(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM documents WHERE length(text) > 0)")
def _(s, d):
    anchors = F.array(F.lit("message queue"), F.lit("network bridge"))
    return C.chunks(s, d).select("chunk_id", (F.size(T.coverage(anchors, F.col("content"))) == 2).alias("both_there"))


#: What makes words, for engines whose boundaries are those of ASCII.
_W = r"\p{L}\p{N}\p{M}\p{Pc}"
_IDENT = rf"""list_distinct(list_concat(regexp_extract_all(l, '{T.COMPOSITE}'), regexp_extract_all(l, '(?:^|[^{_W}])({T.VERSION})(?:$|[^{_W}])', 1), regexp_extract_all(l, '(?:^|[^{_W}-])(--?[A-Za-z][A-Za-z0-9-]*)', 1), regexp_extract_all(l, '(?:^|[^{_W}])({T.HEX})(?:$|[^{_W}])', 1), list_filter(regexp_extract_all(l, '{TERM}'), lambda t: length(t) >= 3 AND regexp_matches(t, '^[!-~]+$') AND regexp_matches(t, '[_0-9]'))))"""
IDENTIFIERS_SQL = f"list_transform(list_sort(list_transform({_IDENT}, lambda x: {{'n': -length(x), 'x': x}})), lambda s: s.x)"
@query("f16_trace_id", f"SELECT query, substring(sha256(query), 1, 12) AS trace_id FROM {ALL_Q}")
def _(s, d):
    return C.all_questions(s, d).select("query", T.trace_id(F.col("query")).alias("trace_id"))


@query("f17_f18_source_names", r"SELECT DISTINCT source, regexp_replace(source, '\.(kg|text)\.md$', '.md') AS family, regexp_replace(regexp_extract('/docs/' || source, '[^/]*$'), '\.(kg|text)\.md$', '.md') AS name FROM documents")
def _(s, d):
    return load(s, d, "documents").select("source").distinct().select("source", T.source_family(F.col("source")).alias("family"), T.display_name(F.concat(F.lit("/docs/"), "source")).alias("name"))


@query("f19_preview_url", "SELECT DISTINCT full_doc_id, '/query/references/' || url_encode(full_doc_id) || '/view?hits=' || url_encode(full_doc_id) || ',' || url_encode('a b') || '#cited-passage' AS url FROM documents WHERE full_doc_id IS NOT NULL")
def _(s, d):
    return load(s, d, "documents").where("full_doc_id is not null").select("full_doc_id").distinct().select("full_doc_id", T.preview_url(F.col("full_doc_id"), F.array("full_doc_id", F.lit("a b"))).alias("url"))


@query("f20_valid_chunk_id", "SELECT DISTINCT source, coalesce(regexp_matches(source, '^[A-Za-z0-9_.:-]{1,200}$'), FALSE) AS valid FROM documents")
def _(s, d):
    return load(s, d, "documents").select("source").distinct().select("source", T.valid_chunk_id(F.col("source")).alias("valid"))


@query("f21_user_query", f"SELECT query, trim(query) AS extracted FROM {ALL_Q}")
def _(s, d):
    return C.all_questions(s, d).select("query", T.user_query(F.concat(F.lit("system ---User Query--- old ---User Query--- "), "query")).alias("extracted"))


_EST = r"(length(regexp_replace(coalesce({0}, ''), '[\x00-\x7f]', '', 'g')) + (length(coalesce({0}, '')) - length(regexp_replace(coalesce({0}, ''), '[\x00-\x7f]', '', 'g')) + 3) // 4 + 12)"


@query("f24_f25_token_budget", f"SELECT DISTINCT result_id, 8 + {_EST.format('question')} + {_EST.format('answer')} AS estimated, least(greatest(400, 1), 512, greatest(1, 4096 - (8 + {_EST.format('question')} + {_EST.format('answer')}) - 128)) AS max_tokens FROM eval_results")
def _(s, d):
    e = load(s, d, "eval_results").select("result_id", T.message_tokens(F.array("question", "answer")).cast("bigint").alias("estimated")).distinct()
    return e.withColumn("max_tokens", T.resolve_max_tokens(F.lit(400).cast("bigint"), 512, 4096, F.col("estimated"), 128))


@query("f26_without_footer", rf"SELECT DISTINCT result_id, md5(regexp_replace(regexp_replace(answer, '(?is)[{C.SPACES}]*(?:^|\n)[ \t]*(?:#{{1,6}}[ \t]*)?(?:references|参考资料|参考文献)[ \t]*[:：]?[ \t]*(?:\n|\[).*$', ''), '[{C.SPACES}]+$', '')) AS digest FROM eval_results WHERE answer IS NOT NULL")
def _(s, d):
    return load(s, d, "eval_results").where("answer is not null").select("result_id", F.md5(T.without_footer(F.col("answer")).cast("binary")).alias("digest")).distinct()


_SYSTEM = "Answer from the given passages."


@query("f28_message_preparation", f"SELECT DISTINCT result_id, '{_SYSTEM}' AS first, question || chr(10) || 'Be brief.' AS last FROM eval_results")
def _(s, d):
    messages = F.array(F.struct(F.lit("system").alias("role"), F.lit(_SYSTEM).alias("content")), F.struct(F.lit("user").alias("role"), F.col("question").alias("content")))
    last = F.transform(messages, lambda m, i: F.when(i == F.size(messages) - 1, F.struct(m["role"].alias("role"), F.concat(m["content"], F.lit("\nBe brief.")).alias("content"))).otherwise(m))
    return load(s, d, "eval_results").select("result_id", F.element_at(last, 1)["content"].alias("first"), F.element_at(last, -1)["content"].alias("last")).distinct()


_HT = r"list_distinct(list_concat(list_filter(regexp_extract_all(lower(heading), '[a-z0-9][a-z0-9_.+-]*'), lambda t: length(t) >= 2), flatten(list_transform(regexp_extract_all(heading, '[\x{3400}-\x{9fff}]+'), lambda t: list_transform(range(1, length(t)), lambda i: substring(t, i, 2))))))"


@query("f29_f30_heading_match", f"SELECT ir_block_id, len({_HT}) AS n_terms, len(list_filter({_HT}, lambda t: contains(lower(content_template), t))) AS hits FROM ir_blocks WHERE heading IS NOT NULL AND content_template IS NOT NULL")
def _(s, d):
    b = load(s, d, "ir_blocks").where("heading is not null and content_template is not null")
    return b.select("ir_block_id", F.size(T.heading_terms(F.col("heading"))).cast("bigint").alias("n_terms"), T.heading_score(F.col("heading"), F.col("content_template")).cast("bigint").alias("hits"))


@query("f31_paragraph_sentences", rf"""SELECT block_id, CASE WHEN len(p) > 1 AND len(list_filter(p, lambda x: length(x) < 12)) = 0 THEN len(p) ELSE 1 END AS n FROM (
SELECT block_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([。！？；!?])', '\1␞', 'g'), '([A-Za-z0-9][.!?]␞?)[{C.SPACES}]+', '\1␞', 'g'), '␞'), lambda x: regexp_replace(x, '^[{C.SPACES}]+|[{C.SPACES}]+$', '', 'g')), lambda x: x <> '') AS p FROM blocks WHERE text IS NOT NULL)""")
def _(s, d):
    return load(s, d, "blocks").where("text is not null").select("block_id", F.size(T.paragraph_sentences(F.col("text"))).cast("bigint").alias("n"))


@query("f33_f35_f36_pagination", "SELECT DISTINCT result_id, http_status <> 200 OR contains(coalesce(error, ''), '<|MORE|>') AS more, 'Continue with page 2. Already found: ' || coalesce(nullif(case_id, ''), 'nothing') || '. Give only what is new.' AS prompt, coalesce(nullif(trim(error), ''), 'none') AS note FROM eval_results")
def _(s, d):
    e = load(s, d, "eval_results")
    return e.select("result_id", T.needs_next_page(F.col("error"), F.col("http_status") != 200).alias("more"), T.continue_prompt(F.lit(2), F.col("case_id")).alias("prompt"), T.prompt_or_default(F.col("error"), "none").alias("note")).distinct()


@query("f34_bounded_join", """WITH n AS (SELECT DISTINCT full_doc_id, source AS name FROM documents WHERE source IS NOT NULL AND full_doc_id IS NOT NULL),
o AS (SELECT *, row_number() OVER w AS k, sum(length(name) + 2) OVER w - 2 AS total FROM n WINDOW w AS (PARTITION BY full_doc_id ORDER BY name)),
g AS (SELECT full_doc_id, count(*) AS n, coalesce(min(k) FILTER (WHERE total > 60 AND k > 1), count(*) + 1) AS cut FROM o GROUP BY full_doc_id)
SELECT full_doc_id, string_agg(name, ', ' ORDER BY k) FILTER (WHERE k < cut) || CASE WHEN cut <= any_value(g.n) THEN ', …' ELSE '' END AS joined FROM o JOIN g USING (full_doc_id) GROUP BY full_doc_id, cut""")
def _(s, d):
    n = load(s, d, "documents").where("source is not null and full_doc_id is not null")
    return n.groupBy("full_doc_id").agg(T.bounded_join(F.collect_set("source"), 60).alias("joined"))


@query("f37_visible_blocks", r"SELECT block_id, coalesce(regexp_matches(text, '[\p{L}\p{N}]'), FALSE) AND NOT coalesce(text_source = 'ocr' AND label IN ('figure', 'abandon'), FALSE) AS visible FROM blocks")
def _(s, d):
    return load(s, d, "blocks").select("block_id", T.visible_block(F.col("text"), F.col("text_source"), F.col("label")).alias("visible"))


@query("f38_heading_filters", r"SELECT block_id, NOT regexp_matches(text, '^\s*[•●▪◦·\-*]') AND length(text) - length(replace(text, '.', '')) < 8 AS structural, CASE WHEN regexp_matches(text, '^\s*[0-9]+(?:\.[0-9]+)+') THEN 'decimal' WHEN regexp_matches(text, '^\s*[0-9]+[.)]') THEN 'number' WHEN regexp_matches(text, '^\s*[A-Za-z][.)]') THEN 'letter' WHEN regexp_matches(text, '^\s*[•●▪◦·\-*]\s') THEN 'bullet' ELSE 'none' END AS style FROM blocks WHERE text IS NOT NULL")
def _(s, d):
    return load(s, d, "blocks").where("text is not null").select("block_id", T.structural_heading(F.col("text")).alias("structural"), T.list_style(F.col("text")).alias("style"))




@query("f39_box_areas", "SELECT block_id, greatest(0, x1::DOUBLE - x0) * greatest(0, y1::DOUBLE - y0) AS area, (x0::DOUBLE + x1) / 2 BETWEEN 300 AND 900 AND (y0::DOUBLE + y1) / 2 BETWEEN 300 AND 900 AS central FROM blocks")
def _(s, d):
    window = tuple(F.lit(float(v)) for v in (300, 300, 900, 900))
    return load(s, d, "blocks").select("block_id", X.area(X.box()).alias("area"), X.center_inside(X.box(), window).alias("central"))


@query("f40_l2_normalise", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)), 6) AS squared, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 6) AS first FROM embeddings")
def _(s, d):
    v = X.l2_normalise(F.col("embedding"))
    return load(s, d, "embeddings").select("vec_id", F.round(X.dot(F.col("embedding"), F.col("embedding")), 6).alias("squared"), F.round(F.get(v, F.lit(0)), 6).alias("first"))


#: Marks that are no part of words are doubled, so that each phrase has its own beside it.
_PHRASE_SQL = T.PHRASE.replace(r"\s", f"[{C.SPACES}]")


@query("f06_named_phrases", rf"SELECT chunk_id, array_to_string(list_transform(regexp_extract_all(c, '(?:^|[^{_W}])({_PHRASE_SQL})(?:$|[^{_W}])', 1), lambda x: lower(regexp_replace(x, '[{C.SPACES}]+', ' ', 'g'))), '|') AS phrases FROM (SELECT doc_id AS chunk_id, regexp_replace(text, '([^{_W}{C.SPACES}])', '\1\1', 'g') AS c FROM documents WHERE length(text) > 0)")
def _(s, d):
    return C.chunks(s, d).select("chunk_id", F.array_join(T.named_phrases(F.col("content")), "|").alias("phrases"))


@query("f12_direct_identifiers", f"SELECT query, array_to_string({IDENTIFIERS_SQL}, '|') AS identifiers FROM (SELECT query, lower(query) AS l FROM {ALL_Q})")
def _(s, d):
    return C.all_questions(s, d).select("query", F.array_join(T.direct_identifiers(F.col("query")), "|").alias("identifiers"))


@query("f13_identifier_coverage", f"SELECT query_id, count(*) AS chunks FROM (SELECT query_id, {IDENTIFIERS_SQL} AS ids FROM (SELECT query_id, lower(query) AS l FROM ({C.QUESTIONS_SQL}))) q JOIN ({C.CHUNKS_SQL}) c ON len(ids) > 0 AND contains(lower(c.content), ids[1]) GROUP BY query_id")
def _(s, d):
    q = C.questions(s, d).select("query_id", F.get(T.direct_identifiers(F.col("query")), F.lit(0)).alias("id")).where("id is not null")
    held = evidence.count_holding(q.select(F.col("id").alias("literal")), C.chunks(s, d).select(F.col("content").alias("text")))
    return q.join(held.withColumnRenamed("literal", "id"), "id").select("query_id", F.col("n").alias("chunks"))


@query("f14_substantive", rf"SELECT block_id, length(regexp_replace(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '(?m)^[{C.SPACES}]{{0,3}}#{{1,6}}[{C.SPACES}].*$', '', 'g'), '^[{C.SPACES}]+|[{C.SPACES}]+$', '', 'g')) >= 24 AS ok FROM blocks WHERE text IS NOT NULL")
def _(s, d):
    return load(s, d, "blocks").where("text is not null").select("block_id", T.substantive(F.col("text")).alias("ok"))


@query("f27_m06_streamed_answers", S["f26_without_footer"])
def _(s, d):
    """Answers that come in small parts, given on as they come without their lists of references."""
    e = load(s, d, "eval_results").where("answer is not null")
    return e.select("result_id", F.md5(passages.streamed_answer("answer").cast("binary")).alias("digest")).distinct()
