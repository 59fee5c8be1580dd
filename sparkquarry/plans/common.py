"""The project's tables in the shapes that operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquarry.functions import text as T
from sparkquarry.sources import load, spread

#: Every hundredth result's question is a query.
QUESTIONS_SQL = "SELECT DISTINCT result_id AS query_id, question AS query FROM eval_results WHERE result_id % 100 = 0 AND question IS NOT NULL"
CHUNKS_SQL = "SELECT doc_id AS chunk_id, text AS content, source AS file_path, full_doc_id, chunk_order_index, content_headings, updated_at FROM documents WHERE length(text) > 0"
MARKDOWN_SQL = "SELECT document_name, string_agg(content_template, chr(10) || chr(10) ORDER BY block_index, ir_block_id) AS markdown FROM ir_blocks WHERE content_template IS NOT NULL GROUP BY document_name"


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "eval_results").where("result_id % 100 = 0 and question is not null").select(F.col("result_id").alias("query_id"), F.col("question").alias("query")).distinct()


def all_questions(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "eval_results").where("question is not null").select(F.col("question").alias("query")).distinct()


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks; a scan of few splits is spread, as terms cost far more than moving the rows."""
    docs = load(spark, sf, "documents").where(F.length("text") > 0).select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("file_path"), "full_doc_id", "chunk_order_index", "content_headings", "updated_at")
    return spread(docs, "chunk_id", factor=1)


def markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Each parsed document as one Markdown text."""
    blocks = load(spark, sf, "ir_blocks").where("content_template is not null")
    ordered = F.array_sort(F.collect_list(F.struct("block_index", "ir_block_id", "content_template")))
    return blocks.groupBy("document_name").agg(F.array_join(F.transform(ordered, lambda x: x["content_template"]), "\n\n").alias("markdown"))


#: Configured types of tables, by words of their headers and of questions.
TABLE_TYPES = [("power", ["power", "battery", "fuse"]), ("network", ["network", "bridge", "gateway"]), ("storage", ["storage", "memory", "cache"]), ("control", ["control", "command", "driver"])]
#: Chunks and, as documents of their own, tables that have a text; a table refers to the block it stands in.
CORPUS_SQL = f"SELECT CAST(chunk_id AS VARCHAR) AS chunk_id, content, 'chunk' AS source_type, CAST(NULL AS BIGINT) AS reference_id, CAST(NULL AS VARCHAR) AS header FROM ({CHUNKS_SQL}) UNION ALL SELECT 't' || table_uid, html, 'table', ir_block_id, array_to_string(table_header, ' ') FROM ir_tables WHERE length(html) > 0"
#: Configured expansions of questions: trigger and what is added.
EXPANSIONS = [("固件", "firmware image"), ("firmware", "固件镜像"), ("电源", "power supply"), ("queue", "message buffer")]
#: White space of any script, for a class of characters.
SPACES = "\\t\\n\\x0b\\x0c\\r\\x1c-\\x20\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_SPACED_SQL = T.SPACED.replace("\\s", f"[{SPACES}]")
#: The query with its expansions; the index text of ``content``.
EXPANDED_SQL = "query || " + " || ".join(f"CASE WHEN contains(lower(query), '{a}') THEN ' {b}' ELSE '' END" for a, b in EXPANSIONS)
_ALIASES_SQL = f"array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(content, '(?:^|[^\\p{{L}}\\p{{N}}\\p{{M}}\\p{{Pc}}])({_SPACED_SQL})', 1), lambda x: regexp_matches(x, '[0-9]')), lambda x: regexp_replace(lower(x), '[^a-z0-9]+', '', 'g')))), ' ')"
INDEX_SQL = f"CASE WHEN {_ALIASES_SQL} = '' THEN content ELSE content || chr(10) || {_ALIASES_SQL} END"
SEARCH_SQL = f"SELECT *, {INDEX_SQL} AS search FROM ({CHUNKS_SQL})"


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks and, as documents of their own, tables that have a text: chunk_id, content, source_type, reference_id, header."""
    t = load(spark, sf, "ir_tables").where(F.length("html") > 0)
    t = t.select(F.concat(F.lit("t"), "table_uid").alias("chunk_id"), F.col("html").alias("content"), F.lit("table").alias("source_type"), F.col("ir_block_id").alias("reference_id"), F.array_join("table_header", " ").alias("header"))
    return chunks(spark, sf).select(F.col("chunk_id").cast("string").alias("chunk_id"), "content", F.lit("chunk").alias("source_type")).unionByName(t, allowMissingColumns=True)


def expanded(queries: DataFrame) -> DataFrame:
    """Queries with ``expanded``: themselves and what the triggers in them add."""
    added = [F.when(F.contains(F.lower("query"), F.lit(a)), F.lit(" " + b)).otherwise("") for a, b in EXPANSIONS]
    return queries.withColumn("expanded", F.concat("query", *added))
