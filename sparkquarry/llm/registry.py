"""The queries of the problems, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkquarry.llm import digest, langid, markup, pack, pairs, scans, sentences, split, tokenize
from sparkquarry.session import checkpoint
from sparkquarry.sources import load


def _grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[float]]:
    grid = load(spark, sf_dir, "percentile_grid").select("record_table", "metric", "quantile")
    return grid, [r[0] for r in grid.select("quantile").distinct().collect()]  # a few rows at any scale


def p1_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of every group by day, and over all days by merging the days' digests."""
    grid, wanted = _grid(spark, sf_dir)
    days = digest.build(digest.metric_rows(spark, sf_dir), [*digest.KEYS, "day"], "value")
    by_day = digest.estimate(days, [*digest.KEYS, "day"], wanted)
    whole = digest.estimate(digest.merge(days, digest.KEYS), digest.KEYS, wanted).withColumn("day", F.lit(None).cast("date"))
    both = by_day.withColumn("span", F.lit("day")).unionByName(whole.withColumn("span", F.lit("all")))
    return both.join(F.broadcast(grid), ["record_table", "metric", "quantile"], "left_semi")


def p1_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles over sets of days: each month's daily digests merged."""
    grid, wanted = _grid(spark, sf_dir)
    days = digest.build(digest.metric_rows(spark, sf_dir), [*digest.KEYS, "day"], "value")
    by = [*digest.KEYS, "month"]
    merged = digest.merge(days.withColumn("month", F.trunc("day", "month")), by)
    return digest.estimate(merged, by, wanted).join(F.broadcast(grid), ["record_table", "metric", "quantile"], "left_semi")


def _rank_check(spark: SparkSession, sf_dir: str, extra: list[str], span) -> DataFrame:
    """Whether each quantile's true rank is within the stated bound, counted over all values; ``extra``: columns of time beside the groups' keys, from ``span``."""
    grid, wanted = _grid(spark, sf_dir)
    rows = digest.metric_rows(spark, sf_dir)
    days = digest.build(rows, [*digest.KEYS, "day"], "value")
    by = [*digest.KEYS, *extra]
    merged = days if extra == ["day"] else digest.merge(span(days), by)
    found = digest.estimate(merged, by, wanted).join(F.broadcast(grid), ["record_table", "metric", "quantile"], "left_semi")
    keys = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in by]
    leaves = span(rows).where("value >= 0 and not isnan(value)").groupBy(*keys, digest.leaf_of(F.col("value")).alias("leaf")).agg(F.count("*").alias("c"))
    found = found.select(*keys, "quantile", "n", "max_rank_error", digest.leaf_of(F.col("value")).alias("at"))
    ranks = leaves.join(found, by).groupBy(*by, "quantile", "n", "max_rank_error").agg(F.sum(F.when(F.col("leaf") < F.col("at"), F.col("c")).otherwise(0)).alias("below"), F.sum(F.when(F.col("leaf") <= F.col("at"), F.col("c")).otherwise(0)).alias("upto"))
    wanted_rank = F.greatest(F.lit(1), F.ceil(F.col("quantile") * F.col("n") - 1e-9 * F.col("n")))
    off = F.greatest(F.lit(0), F.col("below") + 1 - wanted_rank, wanted_rank - F.col("upto"))
    return ranks.select(*by, "quantile", "n", (off <= F.col("max_rank_error")).alias("within_bound"))


def p1_rank_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks over all days, by merged digests."""
    return _rank_check(spark, sf_dir, [], lambda df: df)


def p1_month_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks over each month's days, by merged digests."""
    return _rank_check(spark, sf_dir, ["month"], lambda df: df.withColumn("month", F.trunc("day", "month")))


def p1_day_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks by day."""
    return _rank_check(spark, sf_dir, ["day"], lambda df: df)


def _rank_sql(time: str, name: str) -> str:
    own = f", coalesce(CAST({time} AS VARCHAR), '') AS {name}" if time else ""
    return f"""
WITH a AS (SELECT DISTINCT result_id, query_model, query_mode, started_at, ttft_ms, total_ms FROM eval_results),
v AS (SELECT DISTINCT perf_id, kind, profile, batch_size, started_at, internal_ms_p95 FROM vector_perf),
m AS (
  SELECT 'eval_results' AS record_table, 'ttft_ms' AS metric, coalesce(query_model, '') AS key1, coalesce(query_mode, '') AS key2, '' AS key3, started_at, ttft_ms AS value FROM a
  UNION ALL SELECT 'eval_results', 'total_ms', coalesce(query_model, ''), coalesce(query_mode, ''), '', started_at, total_ms FROM a
  UNION ALL SELECT 'vector_perf', 'internal_ms_p95', coalesce(kind, ''), coalesce(profile, ''), coalesce(CAST(batch_size AS VARCHAR), ''), started_at, internal_ms_p95 FROM v)
SELECT record_table, metric, key1, key2, key3{own}, quantile, count(*) AS n, TRUE AS within_bound
FROM m JOIN percentile_grid USING (record_table, metric)
WHERE value >= 0 AND NOT isnan(value) GROUP BY ALL
"""


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records over their limit: those that the splitter cut."""
    return split.split_items(split.sized_items(spark, sf_dir)).where("piece_no = 1").select("record_table", "record_id")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_items(split.sized_items(spark, sf_dir))


_P5_FOUND = """
SELECT 'parsed_pages' AS record_table, page_uid AS record_id FROM parsed_pages, size_limits s WHERE s.record_table = 'parsed_pages' AND s.field_name = 'native_text' AND length(native_text) > max_chars
UNION ALL SELECT 'blocks', block_id FROM blocks, size_limits s WHERE s.record_table = 'blocks' AND s.field_name = 'text' AND length(text) > max_chars
UNION ALL SELECT 'ir_blocks', ir_block_id FROM ir_blocks, size_limits s WHERE s.record_table = 'ir_blocks' AND s.field_name = 'content_template' AND length(content_template) > max_chars
"""


def p5_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each record whether its pieces keep the limit and share the overlap, and the digest of what they join to."""
    pieces = split.split_items(split.sized_items(spark, sf_dir))
    limits = load(spark, sf_dir, "size_limits").select("record_table", "max_chars", "overlap_chars")
    order = Window.partitionBy("record_table", "record_id").orderBy("piece_no")
    end = F.lag("end_offset").over(order)
    pieces = pieces.join(F.broadcast(limits), "record_table").withColumn("end", end)  # a few rows at any scale
    pieces = pieces.withColumns({"fits": F.char_length("text") <= F.col("max_chars"), "shares": F.when(F.col("end").isNull(), F.col("start_offset") == 0).otherwise(F.col("start_offset") == F.col("end") - F.col("overlap_chars"))})
    own = F.expr("substring(text, coalesce(end, 0) - start_offset + 1)")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", own.alias("t")))), lambda x: x["t"]), "")
    return pieces.groupBy("record_table", "record_id").agg(F.md5(joined.cast("binary")).alias("digest"), F.every("fits").alias("within_limit"), F.every("shares").alias("shares_overlap"))


_P5_CHECK = """
SELECT 'parsed_pages' AS record_table, page_uid AS record_id, md5(native_text) AS digest, TRUE AS within_limit, TRUE AS shares_overlap FROM parsed_pages WHERE native_text IS NOT NULL
UNION ALL SELECT 'blocks', block_id, md5(text), TRUE, TRUE FROM blocks WHERE text IS NOT NULL
UNION ALL SELECT 'ir_blocks', ir_block_id, md5(content_template), TRUE, TRUE FROM ir_blocks WHERE content_template IS NOT NULL
"""


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence ends of the plain text read from files."""
    blocks = load(spark, sf_dir, "blocks").where("label = 'plain text' and text_source = 'pdfium'").select(F.lit("blocks").alias("record_table"), F.col("block_id").alias("record_id"), "text")
    pages = load(spark, sf_dir, "parsed_pages").where("parse_route = 'pdfium_layout'").select(F.lit("parsed_pages").alias("record_table"), F.col("page_uid").alias("record_id"), F.col("native_text").alias("text"))
    return sentences.split_sentences(blocks.unionByName(pages)).select("record_table", "record_id", "end_offset")


def p6_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every block and page."""
    blocks = load(spark, sf_dir, "blocks").select(F.lit("blocks").alias("record_table"), F.col("block_id").alias("record_id"), "text")
    pages = load(spark, sf_dir, "parsed_pages").select(F.lit("parsed_pages").alias("record_table"), F.col("page_uid").alias("record_id"), F.col("native_text").alias("text"))
    return sentences.split_sentences(blocks.unionByName(pages))


def p6_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each record the digest of what its sentences join to, and whether they follow one another without a gap."""
    out = p6_sentences(spark, sf_dir)
    order = Window.partitionBy("record_table", "record_id").orderBy("sentence_no")
    out = out.withColumn("follows", F.col("start_offset") == F.coalesce(F.lag("end_offset").over(order), F.lit(0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence_no", "sentence"))), lambda x: x["sentence"]), "")
    return out.groupBy("record_table", "record_id").agg(F.md5(F.regexp_replace(joined, rf"[{_SPACES}]+\z", "").cast("binary")).alias("digest"), F.every("follows").alias("follows"))


#: White space of any script.
_SPACES = "\t\n\x0b\x0c\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_P6_CHECK = f"""
WITH t AS (SELECT 'blocks' AS record_table, block_id AS record_id, text FROM blocks UNION ALL SELECT 'parsed_pages', page_uid, native_text FROM parsed_pages)
SELECT record_table, record_id, md5(regexp_replace(text, '[{_SPACES}]+$', '')) AS digest, TRUE AS follows FROM t WHERE regexp_matches(text, '[^{_SPACES}]')
"""


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode_corpus(load(spark, sf_dir, "documents"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in a container of each capacity."""
    specs = load(spark, sf_dir, "container_specs").where("tokenizer = 'byte_bpe_50k'")
    return pack.pack_items(tokenize.token_counts(load(spark, sf_dir, "documents")), specs)


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.packing_report(p8_containers(spark, sf_dir))


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each spec the items, whether every bin keeps its capacity, items within it are whole, no token is lost, and the bins are no more than a twentieth over the least number."""
    sizes = checkpoint(tokenize.token_counts(load(spark, sf_dir, "documents")))
    specs = load(spark, sf_dir, "container_specs").where("tokenizer = 'byte_bpe_50k'")
    packed = checkpoint(pack.pack_items(sizes, specs))
    by = ["spec_id", "capacity"]
    bins = packed.groupBy(*by, "bin_id").agg(F.sum("n_tokens").alias("used")).groupBy(*by).agg(F.count("*").alias("bins"), F.every(F.col("used") <= F.col("capacity")).alias("within_capacity"))
    items = packed.groupBy(*by, "item_id").agg(F.count("*").alias("parts"), F.sum("n_tokens").alias("n")).groupBy(*by).agg(F.count("*").alias("items"), F.sum("n").alias("tokens"), F.every(F.col("parts") == F.greatest(F.ceil(F.col("n") / F.col("capacity")), F.lit(1))).alias("undivided"))
    total = sizes.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("total"))  # one row
    out = bins.join(items, by).crossJoin(F.broadcast(total))
    least = F.ceil(F.col("tokens") / F.col("capacity"))
    return out.select("spec_id", "items", "within_capacity", "undivided", (F.col("tokens") == F.col("total")).alias("complete"), (F.col("bins") <= least + F.greatest(F.ceil(least * 0.05), F.lit(2))).alias("tight"))


_P8_CHECK = "SELECT spec_id, (SELECT count(*) FROM documents) AS items, TRUE AS within_capacity, TRUE AS undivided, TRUE AS complete, TRUE AS tight FROM container_specs WHERE tokenizer = 'byte_bpe_50k' AND (SELECT count(*) FROM documents) > 0"


def _languages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, str], langid.Model]:
    codes = langid.read_codes(load(spark, sf_dir, "language_codes"))
    documents = load(spark, sf_dir, "documents")
    return documents, codes, langid.fit(documents, codes)


def _scans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    pages = load(spark, sf_dir, "parsed_pages").select("page_uid", "document_id", "page", "parse_route", "native_text")
    return pages, load(spark, sf_dir, "ocr_texts"), load(spark, sf_dir, "native_glyphs")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.scan_defects(*_scans(spark, sf_dir))


def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.repaired_paragraphs(*_scans(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of markup that the cleaner met in a record."""
    return p3_clean(spark, sf_dir).select("record_table", "record_id", F.explode("markup").alias("markup"))


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_markup(markup.marked_records(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.flag_pairs(load(spark, sf_dir, "eval_results"), _languages(spark, sf_dir)[2])


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the documents whose label is missing or wrong, or that are of several languages."""
    documents, codes, model = _languages(spark, sf_dir)
    labelled = documents.where(F.col("text").rlike(r"(?U)\S")).select("doc_id", "text", langid.label_of(F.col("lang"), codes).alias("_label"))
    found = langid.assign(labelled, model, keep=["_label"])
    return found.where(F.col("_label").isNull() | (F.col("_label") != F.col("lang")) | (F.col("n_segments") > 1)).select("doc_id", "segment_no", "lang")


def p9_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _, model = _languages(spark, sf_dir)
    return langid.assign(documents, model)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The first of each problem's names does the whole job, where there is no pN_found."""
    fs = [p1_quantiles, p1_months, p1_rank_check, p1_month_check, p1_day_check, p2_found, p2_paragraphs, p3_found, p3_clean, p4_found, p5_found, p5_pieces, p5_check, p6_found, p6_sentences, p6_check, p7_ids, p8_containers, p8_report, p8_check, p9_found, p9_languages]
    return {f.__name__: f for f in fs}


def oracle_sql() -> dict[str, str]:
    months, days = _rank_sql("CAST(date_trunc('month', started_at) AS DATE)", "month"), _rank_sql("CAST(started_at AS DATE)", "day")
    return {"p1_rank_check": _rank_sql("", ""), "p1_month_check": months, "p1_day_check": days, "p5_found": _P5_FOUND, "p5_check": _P5_CHECK, "p6_check": _P6_CHECK, "p8_check": _P8_CHECK}
