"""Queries of scans, inverted statistics, vector search and fusion."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkquarry.functions import text as T
from sparkquarry.operators import evidence, fusion, gates, lexical, passages, tables, vectors
from sparkquarry.plans import common as C
from sparkquarry.plans.functions_q import PROFILE_SQL
from sparkquarry.plans.tokens_sql import TERM, bigrams, passage_terms, terms
from sparkquarry.sources import load

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


@query("s01_chunk_scan", "SELECT doc_id AS chunk_id, source AS file_path, 'lexical' AS source_type, length(text) AS n FROM documents WHERE length(text) > 0")
def _(s, d):
    return C.chunks(s, d).select("chunk_id", "file_path", F.lit("lexical").alias("source_type"), F.char_length("content").cast("bigint").alias("n"))


@query("s02_u1_union_table_parents", f"SELECT chunk_id AS id, source_type, reference_id, md5(content) AS digest FROM ({C.CORPUS_SQL})")
def _(s, d):
    return C.corpus(s, d).select(F.col("chunk_id").alias("id"), "source_type", "reference_id", F.md5(F.col("content").cast("binary")).alias("digest"))


@query("s04_j21_table_keys_in_blocks", r"""WITH k AS (SELECT DISTINCT document_name, unnest(regexp_extract_all(content_template, '\{\{TBL:([^{}]+)\}\}', 1)) AS key, ir_block_id FROM ir_blocks)
SELECT t.table_uid, t.placeholder_key, k.ir_block_id AS found_in FROM ir_tables t LEFT JOIN k ON k.key = t.placeholder_key AND k.ir_block_id = t.ir_block_id""")
def _(s, d):
    k = load(s, d, "ir_blocks").select("ir_block_id", F.explode(F.regexp_extract_all("content_template", F.lit(r"\{\{TBL:([^{}]+)\}\}"), F.lit(1))).alias("key")).distinct()
    t = load(s, d, "ir_tables").select("table_uid", "placeholder_key", "ir_block_id")
    return t.join(k.select(F.col("key").alias("placeholder_key"), "ir_block_id", F.col("ir_block_id").alias("found_in")), ["placeholder_key", "ir_block_id"], "left").select("table_uid", "placeholder_key", "found_in")


@query("s08_page_text_sink", "SELECT page_uid, md5(string_agg(text, chr(10) ORDER BY reading_order, block_id)) AS digest, count(*) AS blocks FROM blocks WHERE text IS NOT NULL AND NOT (text_source = 'ocr' AND label = 'figure') GROUP BY page_uid")
def _(s, d):
    b = load(s, d, "blocks").where("text is not null and not (text_source = 'ocr' and label = 'figure')")
    ordered = F.array_sort(F.collect_list(F.struct("reading_order", "block_id", "text")))
    return b.groupBy("page_uid").agg(F.md5(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").cast("binary")).alias("digest"), F.count("*").alias("blocks"))


@query("s14_corpus_snapshot", "SELECT full_doc_id, sha256(string_agg(text, chr(10) ORDER BY chunk_order_index, doc_id)) AS digest FROM documents WHERE text IS NOT NULL GROUP BY full_doc_id")
def _(s, d):
    ordered = F.array_sort(F.collect_list(F.struct("chunk_order_index", "doc_id", "text")))
    return load(s, d, "documents").where("text is not null").groupBy("full_doc_id").agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").cast("binary"), 256).alias("digest"))


POSTINGS_SQL = f"SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({terms('content')}) AS term FROM ({C.CHUNKS_SQL})) GROUP BY ALL"


@query("a01_postings", POSTINGS_SQL)
def _(s, d):
    return lexical.postings(C.chunks(s, d))


@query("a02_document_frequency", f"SELECT term, count(*) AS df FROM ({POSTINGS_SQL}) GROUP BY term")
def _(s, d):
    return lexical.document_frequency(lexical.postings(C.chunks(s, d)))


@query("a03_corpus_stats", f"SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS total, round(avg(len(t)), 6) AS avgdl FROM (SELECT {terms('content')} AS t FROM ({C.CHUNKS_SQL}))")
def _(s, d):
    return lexical.corpus_stats(C.chunks(s, d)).withColumn("avgdl", F.round("avgdl", 6))


BM25_CTE = f"""ch AS MATERIALIZED ({C.SEARCH_SQL}), qs AS MATERIALIZED (SELECT query_id, query, {C.EXPANDED_SQL} AS expanded FROM ({C.QUESTIONS_SQL})),
posts AS MATERIALIZED (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({terms('search')}) AS term FROM ch) GROUP BY ALL), lens AS (SELECT chunk_id, sum(tf) AS len FROM posts GROUP BY chunk_id), st AS (SELECT (SELECT count(*) FROM ch) AS n, (SELECT sum(len) FROM lens) / (SELECT count(*) FROM ch) AS avgdl),
dfs AS (SELECT term, count(*) AS df FROM posts GROUP BY term), qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({terms('expanded')}) AS term FROM qs) GROUP BY ALL),
base AS (SELECT query_id, chunk_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / greatest(avgdl, 1.0)))) AS s FROM qt JOIN dfs USING (term) JOIN posts USING (term) JOIN lens USING (chunk_id), st GROUP BY query_id, chunk_id),
ex AS (SELECT query_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(expanded), '{TERM}'), lambda t: length(t) >= 3 AND (NOT regexp_matches(t, '^\\p{{L}}+$') OR regexp_matches(t, '^[a-z]+$'))))) AS e FROM qs),
held AS MATERIALIZED (SELECT e, chunk_id FROM (SELECT DISTINCT e FROM ex), (SELECT chunk_id, lower(search) AS low FROM ch) WHERE contains(low, e)), boost AS (SELECT query_id, chunk_id, 2.0 * count(*) AS b FROM ex JOIN held USING (e) GROUP BY ALL),
bm AS (SELECT query_id, chunk_id, coalesce(s, 0) + coalesce(b, 0) AS score FROM base FULL JOIN boost USING (query_id, chunk_id)),
lex AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bm WHERE score > 0)"""


def best(s, d, k: int = 12):
    """The best chunks of each question by BM25: query_id, chunk_id, score, rank."""
    return lexical.bm25(C.chunks(s, d), C.expanded(C.questions(s, d)), k)


@query("a04_w01_j1_j2_bm25", f"WITH {BM25_CTE} SELECT query_id, chunk_id, round(score, 5) AS score, rank FROM lex WHERE rank <= 12")
def _(s, d):
    return best(s, d).withColumn("score", F.round("score", 5))


WITH_TABLES_CTE = BM25_CTE.replace(C.CHUNKS_SQL, C.CORPUS_SQL)


def _with_tables(s, d):
    return lexical.bm25(C.corpus(s, d), C.expanded(C.questions(s, d)))


@query("a04_u1_bm25_with_tables", f"WITH {WITH_TABLES_CTE} SELECT query_id, chunk_id, round(score, 5) AS score, rank FROM lex WHERE rank <= 12")
def _(s, d):
    return _with_tables(s, d).withColumn("score", F.round("score", 5))


_COMPACT = "regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]+', '', 'g')"
_HITS = lambda text, words: " + ".join(f"(length({text}) - length(replace({text}, '{w}', ''))) / {len(w)}" for w in words)
_HEAD_SQL, _WHOLE_SQL = _COMPACT.format("header"), f"{_COMPACT.format('header')} || {_COMPACT.format('content')}"
TYPE_SQL = "CASE " + " ".join(f"WHEN {_HITS(_HEAD_SQL, w)} >= 1 THEN '{t}'" for t, w in C.TABLE_TYPES) + " " + " ".join(f"WHEN {_HITS('(' + _WHOLE_SQL + ')', w)} >= 3 THEN '{t}'" for t, w in C.TABLE_TYPES) + " ELSE 'unknown' END"
ASKED_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(query), '{x}')" for x in w) + f" THEN '{t}'" for t, w in C.TABLE_TYPES) + " END"


@query("t08_table_types", f"SELECT table_uid, {TYPE_SQL.replace('content', 'html')} AS type FROM (SELECT table_uid, html, array_to_string(table_header, ' ') AS header FROM ir_tables)")
def _(s, d):
    return load(s, d, "ir_tables").select("table_uid", tables.table_type(F.array_join("table_header", " "), F.col("html"), C.TABLE_TYPES).alias("type"))


@query("t12_asked_types", f"SELECT query_id, {ASKED_SQL} AS asked FROM ({C.QUESTIONS_SQL})")
def _(s, d):
    return C.questions(s, d).select("query_id", tables.asked_type(F.col("query"), C.TABLE_TYPES).alias("asked"))


@query("t15_reserved_tables", f"""WITH {WITH_TABLES_CTE}, c AS (SELECT query_id, chunk_id, rank, source_type = 'table' AND coalesce({TYPE_SQL} = {ASKED_SQL}, FALSE) AS typed FROM lex JOIN (SELECT * FROM ({C.CORPUS_SQL})) USING (chunk_id) JOIN ({C.QUESTIONS_SQL}) USING (query_id) WHERE rank <= 12),
m AS (SELECT *, max(typed) OVER (PARTITION BY query_id) AS any_typed FROM c) SELECT query_id, chunk_id, rank FROM m WHERE typed OR NOT any_typed""")
def _(s, d):
    """Of each question's best chunks and tables the tables of the type it asks for, if there are any."""
    c = _with_tables(s, d).join(C.corpus(s, d), "chunk_id").join(C.questions(s, d), "query_id")
    typed = (F.col("source_type") == "table") & (tables.table_type(F.col("header"), F.col("content"), C.TABLE_TYPES) == tables.asked_type(F.col("query"), C.TABLE_TYPES))
    return gates.keep_if_any(c.withColumn("typed", typed), "typed").select("query_id", "chunk_id", "rank")


VECTOR_SQL = """SELECT query_id, vec_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM (
SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) AS similarity FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0) QUALIFY rank <= 10"""


@query("w02_cosine_top_k", f"SELECT query_id, vec_id, round(similarity, 6) AS similarity, rank FROM ({VECTOR_SQL})")
def _(s, d):
    e = load(s, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vectors.cosine_top_k(e, q).withColumn("similarity", F.round("similarity", 6))


def _indexed(s, d):
    e = load(s, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return e, q, vectors.indexed_top_k(vectors.build_index(e), q)


@query("w02_indexed_top_k")
def _(s, d):
    return _indexed(s, d)[2].withColumn("similarity", F.round("similarity", 6))


@query("w02_index_recall", "SELECT count(*) AS queries, TRUE AS enough, TRUE AS exact FROM embeddings WHERE vec_id % 100 = 0")
def _(s, d):
    """Whether the index finds nine of ten rows that brute force does, and all it finds have their exact similarity."""
    e, q, found = _indexed(s, d)
    true = vectors.cosine_top_k(e, q).select("query_id", "vec_id", F.col("similarity").alias("true"))
    both = true.join(found.select("query_id", "vec_id", "similarity"), ["query_id", "vec_id"], "left")
    total = both.agg(F.count("similarity").alias("hits"), F.count("*").alias("all"), F.coalesce(F.every(F.col("similarity").isNull() | (F.abs(F.col("similarity") - F.col("true")) < 1e-6)), F.lit(True)).alias("exact"))
    return total.crossJoin(q.agg(F.count("*").alias("queries"))).select("queries", (F.col("hits") >= 0.9 * F.col("all")).alias("enough"), "exact")


WEIGHTS_SQL = f"""SELECT query_id, query, profile, CASE profile WHEN 'table' THEN 0.85 WHEN 'exact' THEN 0.75 WHEN 'semantic' THEN 1.5 WHEN 'document_fact' THEN 1.5 ELSE 1.0 END AS wv, CASE profile WHEN 'table' THEN 2.75 WHEN 'exact' THEN 2.5 WHEN 'semantic' THEN 1.0 WHEN 'relation_fact' THEN 1.75 ELSE 1.5 END AS wl,
CASE WHEN profile IN ('exact', 'table', 'document_fact') THEN 12 ELSE 6 END AS k, CASE WHEN profile IN ('exact', 'table', 'document_fact') THEN 9 ELSE 3 END AS n, CASE profile WHEN 'exact' THEN 12 WHEN 'table' THEN 12 WHEN 'document_fact' THEN 12 WHEN 'relation_fact' THEN 64 ELSE 6 END AS scan FROM (SELECT query_id, query, {PROFILE_SQL} AS profile FROM ({C.QUESTIONS_SQL}))"""


@query("p08_p09_p10_w_profile_weights", f"SELECT query_id, profile, wv AS w_vector, wl AS w_lexical, k, n FROM ({WEIGHTS_SQL})")
def _(s, d):
    p = fusion.profiled(C.questions(s, d))
    return p.select("query_id", "profile", "w_vector", "w_lexical", fusion.candidate_k(F.col("profile"), 3).alias("k"), fusion.rerank_n(F.col("profile"), F.lit(9), 3).alias("n"))


COS_CTE = f"""cw AS MATERIALIZED (SELECT chunk_id, term, 1 + ln(count(*)) AS w FROM (SELECT chunk_id, unnest({passage_terms('content')}) AS term FROM ({C.CHUNKS_SQL})) GROUP BY ALL), cn AS (SELECT chunk_id, sqrt(sum(w * w)) AS norm FROM cw GROUP BY chunk_id), cd AS (SELECT term, count(*) AS df FROM cw GROUP BY term),
cq AS (SELECT query_id, term, (1 + ln(qtf)) * ln(1 + (SELECT count(*) FROM ({C.CHUNKS_SQL})) / df) AS qw FROM (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({passage_terms('query')}) AS term FROM ({C.QUESTIONS_SQL})) GROUP BY ALL) JOIN cd USING (term)), cqn AS (SELECT query_id, sqrt(sum(qw * qw)) AS qnorm FROM cq GROUP BY query_id),
co AS (SELECT query_id, chunk_id, round(sum(qw * w / norm / qnorm), 9) AS score FROM cq JOIN cqn USING (query_id) JOIN cw USING (term) JOIN cn USING (chunk_id) GROUP BY query_id, chunk_id),
cos AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM co QUALIFY rank <= 12)"""
TOP_CTE = f"{BM25_CTE}, top AS (SELECT query_id, chunk_id, rank FROM lex WHERE rank <= 12)"
FUSED_CTE = f"""{BM25_CTE}, {COS_CTE}, w AS ({WEIGHTS_SQL}),
fa AS (SELECT query_id, chunk_id, d.rank AS vector_rank, l.rank AS lexical_rank, coalesce(wv / (60.0 + d.rank), 0) + coalesce(wl / (60.0 + l.rank), 0) AS score, k FROM cos d FULL JOIN (SELECT l.* FROM lex l JOIN w USING (query_id) WHERE rank <= scan) l USING (query_id, chunk_id) JOIN w USING (query_id)),
fu AS (SELECT query_id, chunk_id, vector_rank, lexical_rank, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fa) WHERE rank <= k)"""
DIRECT_SQL = f"""(12 * len(list_filter(list_distinct(regexp_extract_all(lower(query), '[a-z][a-z0-9]*(?:[._/:+-][a-z0-9]+)+')), lambda t: contains(lower({{0}}), t))) + 3 * len(list_filter(list_distinct(regexp_extract_all(lower(query), '[a-z][a-z0-9_-]+')), lambda t: contains(lower({{0}}), t)))
 + len(list_filter({bigrams("array_to_string(regexp_extract_all(query, '[\\x{{3400}}-\\x{{9fff}}]'), '')")}, lambda t: contains(lower({{0}}), t))))"""


def _cosine(s, d):
    return lexical.cosine(C.chunks(s, d), C.questions(s, d)).select("query_id", "chunk_id", "rank")


def _top(s, d):
    return best(s, d).select("query_id", "chunk_id", "rank")


@query("w02_text_cosine", f"WITH {COS_CTE} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM cos")
def _(s, d):
    return lexical.cosine(C.chunks(s, d), C.questions(s, d)).withColumn("score", F.round("score", 6))


@query("a05_j3_w3_w4_rrf", f"WITH {FUSED_CTE} SELECT query_id, chunk_id, vector_rank, lexical_rank, round(score, 9) AS score, rank FROM fu")
def fused(s, d):
    """Cosine and BM25 over all chunks fused; of both lists as many as the question's profile asks for."""
    return fusion.fuse(_cosine(s, d), best(s, d, fusion.RELATION_SCAN), C.questions(s, d)).withColumn("score", F.round("score", 9))


@query("a06_w13_rerank_fusion", f"""WITH {FUSED_CTE}, r AS (SELECT query_id, chunk_id, rank AS retrieval_rank, lexical_rank, row_number() OVER (PARTITION BY query_id ORDER BY {DIRECT_SQL.format('content')} DESC, chunk_id) AS rerank_rank FROM fu JOIN ({C.CHUNKS_SQL}) c USING (chunk_id) JOIN ({C.QUESTIONS_SQL}) USING (query_id)),
z AS (SELECT r.*, CASE WHEN profile IN ('exact', 'table', 'document_fact', 'relation_fact') THEN 1.0 / (60.0 + rerank_rank) + 0.7 / (60.0 + retrieval_rank) + coalesce(1.5 / (60.0 + lexical_rank), 0) END AS score FROM r JOIN w USING (query_id))
SELECT query_id, chunk_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, CASE WHEN score IS NULL THEN rerank_rank ELSE retrieval_rank END, chunk_id) AS final_rank FROM z""")
def _(s, d):
    r = fused(s, d).select("query_id", "chunk_id", F.col("rank").alias("retrieval_rank"), "lexical_rank").join(C.questions(s, d), "query_id").join(C.chunks(s, d).select("chunk_id", "content"), "chunk_id")
    r = r.withColumn("_direct", evidence.unit_score(F.col("query"), F.col("content"), F.lit(False))).drop("query", "content")
    r = r.withColumn("rerank_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_direct"), "chunk_id")))
    return fusion.fuse_after_rerank(r, C.questions(s, d)).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "final_rank")


@query("w05_protected_slot", f"WITH {BM25_CTE}, {COS_CTE}, den AS (SELECT query_id, chunk_id, rank FROM cos), best AS (SELECT query_id, chunk_id FROM lex WHERE rank = 1) SELECT query_id, chunk_id, rank, FALSE AS protected FROM den d WHERE NOT (rank = (SELECT max(rank) FROM den x WHERE x.query_id = d.query_id) AND EXISTS (SELECT 1 FROM best b WHERE b.query_id = d.query_id AND b.chunk_id NOT IN (SELECT chunk_id FROM den y WHERE y.query_id = d.query_id))) UNION ALL SELECT b.query_id, b.chunk_id, (SELECT max(rank) FROM den x WHERE x.query_id = b.query_id), TRUE FROM best b WHERE b.query_id IN (SELECT query_id FROM den) AND b.chunk_id NOT IN (SELECT chunk_id FROM den y WHERE y.query_id = b.query_id)")
def _(s, d):
    return fusion.protect(_cosine(s, d), best(s, d, 1).select("query_id", "chunk_id"))


_PHRASE = rf"(?:^|[^\p{{L}}\p{{N}}\p{{M}}\p{{Pc}}])({T.PHRASE})"
_ANCHOR_CASES = " ".join(f"WHEN contains(query, '{m}') AND list_extract(regexp_extract_all(split_part(query, '{m}', 1), '{_PHRASE}', 1), -1) <> '' AND regexp_extract(substring(query, instr(query, '{m}') + {len(m)}), '{_PHRASE}', 1) <> '' THEN [lower(list_extract(regexp_extract_all(split_part(query, '{m}', 1), '{_PHRASE}', 1), -1)), lower(regexp_extract(substring(query, instr(query, '{m}') + {len(m)}), '{_PHRASE}', 1))]" for m in T.RELATION_MARKERS)


@query("w05_relation_slot", f"""WITH {FUSED_CTE}, an AS (SELECT query_id, CASE {_ANCHOR_CASES} END AS a FROM w WHERE profile = 'relation_fact'),
rel AS (SELECT query_id, chunk_id, rank FROM lex JOIN an USING (query_id) JOIN ch USING (chunk_id) WHERE rank <= 64 AND contains(lower(content), a[1]) AND contains(lower(content), a[2]) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) = 1),
mi AS (SELECT query_id, chunk_id FROM rel ANTI JOIN fu USING (query_id, chunk_id))
SELECT query_id, chunk_id, rank, FALSE AS protected FROM fu f WHERE NOT (rank = (SELECT max(rank) FROM fu x WHERE x.query_id = f.query_id) AND query_id IN (SELECT query_id FROM mi)) UNION ALL SELECT query_id, chunk_id, (SELECT max(rank) FROM fu x WHERE x.query_id = mi.query_id), TRUE FROM mi""")
def _(s, d):
    """The first lexical chunk that states a question's relation directly takes the last place of the fused list, if it isn't in it."""
    scan = best(s, d, fusion.RELATION_SCAN)
    direct = fusion.direct_relation(scan.join(C.chunks(s, d).select("chunk_id", "content"), "chunk_id"), C.questions(s, d))
    return fusion.protect(fusion.fuse(_cosine(s, d), scan, C.questions(s, d)).select("query_id", "chunk_id", "rank"), direct)


@query("w12_p01_round_robin", f"WITH {BM25_CTE}, {COS_CTE}, den AS (SELECT query_id, chunk_id, rank FROM cos), a AS (SELECT query_id, chunk_id, rank, 0 AS list_no FROM den UNION ALL SELECT query_id, chunk_id, rank, 1 FROM lex WHERE rank <= 6), f AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank, list_no) AS n FROM a) SELECT query_id, chunk_id, rank, list_no, row_number() OVER (PARTITION BY query_id ORDER BY rank, list_no) AS position FROM f WHERE n = 1")
def _(s, d):
    return fusion.round_robin(_cosine(s, d), fusion.limit_graph(_top(s, d), "mix"))


@query("j04_focused_overwrite")
def _(s, d):
    """Candidates of the cosine list whose text gives way to the focused passage that the lexical list has of the same chunk."""
    focused = passages.best_passages(_top(s, d), C.chunks(s, d), C.expanded(C.questions(s, d))).select("query_id", "chunk_id", F.col("passage").alias("content"))
    rows = _cosine(s, d).join(C.chunks(s, d).select("chunk_id", "content"), "chunk_id")
    return fusion.overwrite(rows.select("query_id", "chunk_id", "content"), focused).select("query_id", "chunk_id", F.md5(F.col("content").cast("binary")).alias("digest"), "changed")


@query("p04_anchor_gate", rf"""WITH {TOP_CTE}, q AS (SELECT query_id, list_distinct(regexp_extract_all(lower(regexp_replace(query, '[^\x00-\x7f]', ' ', 'g')), '\b[a-z][a-z0-9._:+/-]{{3,}}\b')) AS an, regexp_matches(query, '[A-Z]{{5}}|[0-9]') AS strict FROM ({C.QUESTIONS_SQL})),
h AS (SELECT query_id, chunk_id, strict, len(list_filter(an, lambda a: contains(lower(content), a))) > 0 AS hit, len(an) AS n FROM top JOIN q USING (query_id) JOIN ({C.CHUNKS_SQL}) c USING (chunk_id)),
m AS (SELECT *, max(hit) OVER (PARTITION BY query_id) AS any_hit FROM h) SELECT query_id, chunk_id FROM m WHERE n = 0 OR hit OR (NOT any_hit AND NOT strict)""")
def _(s, d):
    rows = _top(s, d).join(C.chunks(s, d).select("chunk_id", "content"), "chunk_id").join(C.questions(s, d), "query_id")
    return evidence.anchor_gate(rows).select("query_id", "chunk_id")


@query("j05_j17_reference_lookup", "SELECT DISTINCT e.result_id, r.reference_id, count(d.doc_id) OVER (PARTITION BY e.result_id, e.received_at, r.reference_id, r.file_path) AS chunks FROM eval_results e, unnest(e.cited_references) u(r) LEFT JOIN (SELECT DISTINCT source, 1 AS doc_id FROM documents WHERE source IS NOT NULL) d ON d.source = r.file_path")
def _(s, d):
    r = load(s, d, "eval_results").select("result_id", "received_at", F.explode("cited_references").alias("r")).select("result_id", "received_at", "r.reference_id", "r.file_path")
    known = load(s, d, "documents").where("source is not null").select(F.col("source").alias("file_path"), F.lit(1).alias("doc_id")).distinct()
    w = Window.partitionBy("result_id", "received_at", "reference_id", "file_path")
    return r.join(known, "file_path", "left").select("result_id", "reference_id", F.count("doc_id").over(w).alias("chunks")).distinct()


@query("j08_families_with_text", r"""SELECT doc_id FROM documents k WHERE source LIKE '%.kg.md' AND NOT EXISTS (SELECT 1 FROM documents t WHERE t.source LIKE '%.text.md' AND t.full_doc_id = k.full_doc_id AND regexp_replace(t.source, '\.(kg|text)\.md$', '.md') = regexp_replace(k.source, '\.(kg|text)\.md$', '.md'))""")
def _(s, d):
    docs = load(s, d, "documents").select("doc_id", "full_doc_id", "source", T.source_family(F.col("source")).alias("family"))
    primary = docs.where("source like '%.text.md'").select("full_doc_id", "family").distinct()
    return docs.where("source like '%.kg.md'").join(primary, ["full_doc_id", "family"], "left_anti").select("doc_id")


@query("j20_sibling_expansion", "SELECT DISTINCT b.doc_id FROM documents a JOIN documents b ON a.full_doc_id = b.full_doc_id AND a.source = b.source WHERE a.doc_id % 100 = 0")
def _(s, d):
    docs = load(s, d, "documents").select("doc_id", "full_doc_id", "source")
    return docs.join(docs.where("doc_id % 100 = 0").select("full_doc_id", "source").distinct(), ["full_doc_id", "source"], "left_semi").select("doc_id").distinct()


@query("p07_w_diagnostic_filter", f"""WITH {BM25_CTE}, l AS (SELECT query_id, chunk_id, score / max(score) OVER (PARTITION BY query_id) AS s, rank FROM lex WHERE rank <= 12) SELECT query_id, chunk_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS k FROM l WHERE s >= 0.3) WHERE k <= 2""")
def _(s, d):
    from sparkquarry.operators.evidence import relative_floor

    l = best(s, d)
    l = l.withColumn("score", F.col("score") / F.max("score").over(Window.partitionBy("query_id")))
    return relative_floor(l, 0.5, 0.3, 2).select("query_id", "chunk_id", "rank")


@query("p11_authority_scores", f"""SELECT chunk_id, round(1.0 * CASE WHEN file_path LIKE '%release%' THEN 0.2 ELSE 1.0 END * CASE WHEN length(content) < 160 AND NOT contains(content, '--') AND NOT contains(content, '/') THEN 0.25 ELSE 1.0 END, 6) AS factor FROM ({C.CHUNKS_SQL})""")
def _(s, d):
    from sparkquarry.operators.evidence import authority_factor

    return C.chunks(s, d).select("chunk_id", F.round(authority_factor(F.col("content"), F.col("file_path"), "%release%"), 6).alias("factor"))


@query("p16_p19_previews", rf"""SELECT doc_id, regexp_extract(source, '^(.*)\.(kg|text)\.md$', 2) AS route, length(text) > 20000 AS truncated, length(text) > 2000000 AS cut_in_full, md5(substring(text, 1, 20000)) AS digest, coalesce(full_doc_id || ':' || regexp_replace(source, '\.(kg|text)\.md$', '.md'), full_doc_id, CAST(doc_id AS VARCHAR)) AS group_id FROM documents WHERE text IS NOT NULL""")
def _(s, d):
    docs = load(s, d, "documents").where("text is not null")
    group = F.coalesce(F.concat("full_doc_id", F.lit(":"), T.source_family(F.col("source"))), F.col("full_doc_id"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", F.regexp_extract("source", r"^(.*)\.(kg|text)\.md$", 2).alias("route"), (F.char_length("text") > 20_000).alias("truncated"), (F.char_length("text") > 2_000_000).alias("cut_in_full"), F.md5(F.substring("text", 1, 20_000).cast("binary")).alias("digest"), group.alias("group_id"))


def scored_units(s, d):
    """The lines of each question's best chunks: query_id, chunk_rank, chunk_id, unit_index, line, direct."""
    pairs = _top(s, d).join(C.chunks(s, d).select("chunk_id", "content"), "chunk_id").join(C.questions(s, d), "query_id")
    u = pairs.select("query_id", F.col("rank").alias("chunk_rank"), "chunk_id", "query", F.posexplode(F.split("content", "\n")).alias("unit_index", "line")).where("trim(line) <> ''")
    return u.withColumn("direct", evidence.unit_score(F.col("query"), F.col("line"), F.lit(False)))


UNITS_SQL = f"""{TOP_CTE}, u AS (SELECT query_id, rank AS chunk_rank, chunk_id, i - 1 AS unit_index, query, l[i] AS line FROM (SELECT query_id, rank, chunk_id, query, string_split(content, chr(10)) AS l FROM top JOIN ({C.CHUNKS_SQL}) c USING (chunk_id) JOIN ({C.QUESTIONS_SQL}) q USING (query_id)), unnest(range(1, len(l) + 1)) t(i) WHERE trim(l[i], ' ') <> ''),
x AS (SELECT *, {DIRECT_SQL.format('line')} AS direct FROM u)"""


@query("w09_w10_candidate_units", f"WITH {UNITS_SQL}, y AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_rank ORDER BY direct DESC, unit_index) AS depth FROM x) SELECT query_id, chunk_rank, unit_index, direct, row_number() OVER (PARTITION BY query_id ORDER BY depth, chunk_rank) AS position FROM y WHERE depth <= 8 QUALIFY position <= 24")
def _(s, d):
    return evidence.candidate_units(scored_units(s, d)).select("query_id", "chunk_rank", "unit_index", F.col("direct").cast("bigint").alias("direct"), "position")


def admission_units(s, d):
    """The candidate units with section, the last heading above them in the chunk; score, their direct score as a share of the question's best; and size."""
    above = Window.partitionBy("query_id", "chunk_rank").orderBy("unit_index").rowsBetween(Window.unboundedPreceding, 0)
    u = scored_units(s, d).withColumn("section", F.coalesce(F.last(F.when(F.col("line").rlike(r"^#{1,6}\s"), F.trim("line")), ignorenulls=True).over(above), F.lit("")))
    u = evidence.candidate_units(u).withColumn("_most", F.max("direct").over(Window.partitionBy("query_id")))
    score = F.when(F.col("_most") > 0, F.col("direct") / F.col("_most")).otherwise(0.0)
    return u.select("query_id", "chunk_rank", "unit_index", "section", score.alias("score"), F.char_length("line").cast("bigint").alias("size"))


@query("w11_admission")
def _(s, d):
    return evidence.admit(admission_units(s, d)).select("query_id", "chunk_rank", "unit_index", F.round("score", 6).alias("score"))


def _top_lines(s, d):
    """query_id, chunk_id, line_no, line, query: all lines of each question's best chunks."""
    pairs = _top(s, d).join(C.chunks(s, d).select("chunk_id", "content"), "chunk_id").join(C.questions(s, d), "query_id")
    return pairs.select("query_id", "chunk_id", "query", F.posexplode(F.split("content", "\n")).alias("line_no", "line"))


LINES_SQL = f"""{TOP_CTE}, l AS (SELECT query_id, chunk_id, query, i - 1 AS line_no, x[i] AS line FROM (SELECT query_id, chunk_id, query, string_split(content, chr(10)) AS x FROM top JOIN ({C.CHUNKS_SQL}) c USING (chunk_id) JOIN ({C.QUESTIONS_SQL}) q USING (query_id)), unnest(range(1, len(x) + 1)) t(i))"""


@query("f15_line_scores", f"""WITH {LINES_SQL}, a AS (SELECT query_id, line_id, term, count(*) AS n FROM (SELECT query_id, chunk_id || '-' || line_no AS line_id, unnest({terms('line')}) AS term FROM l) GROUP BY ALL), b AS (SELECT query_id, term, count(*) AS m FROM (SELECT query_id, unnest({terms('query')}) AS term FROM ({C.QUESTIONS_SQL})) GROUP BY ALL)
SELECT query_id, line_id, CAST(sum(least(n, m)) AS BIGINT) AS score FROM a JOIN b USING (query_id, term) GROUP BY ALL""")
def _(s, d):
    return lexical.line_scores(_top_lines(s, d).select("query_id", F.concat_ws("-", "chunk_id", "line_no").alias("line_id"), "line"), C.questions(s, d))


@query("t19_t21_compact_lines", f"WITH {LINES_SQL}, h AS (SELECT query_id, chunk_id, line_no, len(list_filter(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]{{3,}}')), lambda w: contains(lower(line), w))) AS hits FROM l) SELECT query_id, chunk_id, line_no, hits FROM h QUALIFY hits > 0 AND hits = max(hits) OVER (PARTITION BY query_id, chunk_id)")
def _(s, d):
    hits = F.size(F.filter(F.array_distinct(F.regexp_extract_all(F.lower("query"), F.lit("[a-z0-9]{3,}"), F.lit(0))), lambda w: F.contains(F.lower("line"), w)))
    l = _top_lines(s, d).select("query_id", "chunk_id", "line_no", hits.cast("bigint").alias("hits"))
    return l.withColumn("_m", F.max("hits").over(Window.partitionBy("query_id", "chunk_id"))).where("hits > 0 and hits = _m").drop("_m")
