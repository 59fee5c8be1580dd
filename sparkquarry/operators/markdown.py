"""Markdown structure by windows over lines: fences, headings and their paths, blocks, sections, pipe tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Patterns of lines, and of headings whose sections are reference matter.
HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
DELIMITER = r"^\s*\|?(?:\s*:?-{3,}:?\s*\|)+\s*$"
LOG = r"(?i)(?:^|\s)(?:\d{4}-\d\d-\d\d|\d\d:\d\d:\d\d|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|Traceback|Exception|kernel:|dmesg:|\[[0-9.]+\])"
SHELL = r"^\s*(?:[$#]|sudo\s+|adb\s+|curl\s+|python(?:3)?\s+|export\s+|systemctl\s+)"
LOW_VALUE = r"(?i)(?:目录|修订记录|更新记录|版本(?:信息|记录|历史)?|变更记录|参考(?:文献|资料)?|附录|文件清单|命令清单|参数(?:表|列表|配置表)|术语表|索引|copyright|revision|changelog|references?|appendix|table\s+of\s+contents)"


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, line_no, line, in_fence, fence, level, title``, and in ``path`` the titles of the headings over or on the line."""
    out = docs.select(key, F.posexplode(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")).alias("line_no", "line"))
    upto = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("fence", F.col("line").rlike(r"^\s*(```|~~~)"))
    out = out.withColumn("in_fence", F.col("fence") | (F.sum(F.col("fence").cast("int")).over(upto) % 2 == 1))
    level = F.char_length(F.regexp_extract("line", HEADING, 1))
    out = out.withColumn("level", F.when(~F.col("in_fence") & (level > 0), level).otherwise(0)).withColumn("title", F.when(F.col("level") > 0, F.regexp_extract("line", HEADING, 2)))
    latest = {f"_h{i}": F.last(F.when(F.col("level") == i, F.struct("line_no", "title")), ignorenulls=True).over(upto) for i in range(1, 7)}
    out = out.withColumns(latest)
    parts = [F.when(F.col(f"_h{i}").isNotNull() & (F.greatest(F.lit(-1), *(F.coalesce(F.col(f"_h{j}.line_no"), F.lit(-1)) for j in range(1, i)), F.lit(-1)) < F.col(f"_h{i}.line_no")), F.col(f"_h{i}.title")) for i in range(1, 7)]
    return out.withColumn("path", F.array_compact(F.array(*parts))).drop(*latest)


def blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, block_no, path, n_lines, reason, kind``: fences whole, tables whole, paragraphs to the next blank line; headings are none."""
    w = Window.partitionBy(key).orderBy("line_no")
    rows = lines(docs, key, text).withColumn("piped", ~F.col("in_fence") & F.contains("line", F.lit("|")))
    rows = rows.withColumn("table_starts", F.col("piped") & F.coalesce(F.lead("line").over(w).rlike(DELIMITER), F.lit(False)) & ~F.col("line").rlike(DELIMITER))
    blank = (F.trim("line") == "") & ~F.col("in_fence")
    rows = rows.withColumn("body", ~blank & (F.col("level") == 0))
    fence_no = F.sum(F.col("fence").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    opens = F.col("fence") & (fence_no % 2 == 1)
    before = lambda c: F.coalesce(F.lag(c).over(w), F.lit(False))
    rows = rows.withColumn("opens", opens).withColumn("closes", F.col("fence") & ~F.col("opens"))
    table_no = F.sum(F.when(F.col("table_starts"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_t", table_no).withColumn("_break", F.last(F.when(~F.col("piped") | ~F.col("body"), F.col("line_no")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_ts", F.last(F.when(F.col("table_starts"), F.col("line_no")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("in_table", F.coalesce(F.col("body") & F.col("piped") & (F.col("_ts") > F.coalesce("_break", F.lit(-1))), F.lit(False)))
    starts = F.col("body") & (~before("body") | F.col("opens") | before("closes") | F.col("table_starts") | (before("in_table") & ~F.col("in_table")))
    rows = rows.withColumn("block_no", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("body")
    b = rows.groupBy(key, "block_no").agg(
        F.min_by("path", "line_no").alias("path"), F.count("*").alias("n_lines"), F.bool_or("in_fence").alias("fenced"), F.bool_or("in_table").alias("tabled"),
        F.count_if(F.col("line").rlike(LOG)).alias("logs"), F.count_if(F.col("line").rlike(SHELL)).alias("commands"),
    )
    many = lambda c: F.col(c) >= F.greatest(F.lit(2), F.floor(F.col("n_lines") / 2))
    reason = F.when(F.array_join("path", " / ").rlike(LOW_VALUE), "low_value_section").when(F.col("fenced"), "fenced_code").when(F.col("tabled"), "markdown_table").when(many("logs"), "raw_log").when(many("commands"), "command_list").otherwise("semantic_prose")
    return b.withColumn("reason", reason).withColumn("kind", F.when(F.col("reason") == "semantic_prose", "kg").otherwise("text")).select(key, "block_no", "path", "n_lines", "reason", "kind")


def sections(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, heading, level, first_line, end_line``: each heading to the next of its level or above, where there is a body."""
    rows = lines(docs, key, text)
    after = Window.partitionBy(key).orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    ends = F.lit(None).cast("int")
    for i in range(6, 0, -1):
        ends = F.when(F.col("level") == i, F.min(F.when((F.col("level") > 0) & (F.col("level") <= i), F.col("line_no"))).over(after)).otherwise(ends)
    rows = rows.withColumn("end_line", F.coalesce(ends, F.max("line_no").over(Window.partitionBy(key)) + 1)).withColumn("next_text", F.min(F.when(F.trim("line") != "", F.col("line_no"))).over(after))
    return rows.where("level > 0 and next_text < end_line").select(key, F.regexp_replace("title", "[*`_]+", "").alias("heading"), "level", F.col("line_no").alias("first_line"), "end_line")


def pipe_tables(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, table_no, title, header, n_rows``: runs of two or more lines between bars, the second of which is no row."""
    w = Window.partitionBy(key).orderBy("line_no")
    rows = lines(docs, key, text).withColumn("bar", F.col("line").rlike(r"^\s*\|.*\|\s*$"))
    rows = rows.withColumn("new", F.col("bar") & ~F.coalesce(F.lag("bar").over(w), F.lit(False)))
    above = F.coalesce(*(F.when(~F.lag("bar", i).over(w) & (F.trim(F.lag("line", i).over(w)) != "") & ~F.lag("line", i).over(w).rlike("^[-| :]+$"), F.lag("line", i).over(w)) for i in (1, 2, 3)), F.lit(""))
    rows = rows.withColumn("title", F.when(F.col("new"), F.regexp_replace(F.trim(above), r"^#{1,6}\s+", ""))).withColumn("table_no", F.sum(F.col("new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("bar")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(key, "table_no").orderBy("line_no")))
    t = rows.groupBy(key, "table_no").agg(F.min_by("title", "n").alias("title"), F.min_by("line", "n").alias("_head"), F.max("n").alias("_size"), F.count_if((F.col("n") > 2) & ~F.col("line").rlike(r"^\s*\|?\s*:?-{2,}")).alias("n_rows"))
    return t.where("_size >= 2").withColumn("header", F.transform(F.split(F.regexp_replace(F.trim("_head"), r"^\|+|\|+$", ""), r"\|"), lambda x: F.trim(x))).drop("_head", "_size")


def extraction_windows(text, most: int = 220):
    """A text's sentences packed in order into windows of at most ``most`` characters; longer sentences are cut with an overlap."""
    overlap = min(40, most // 5)
    whole = F.filter(F.transform(F.regexp_extract_all(F.trim(text), F.lit(r"[^。！？；.!?\n]+(?:[。！？；.!?]+|\n+|$)"), F.lit(0)), lambda s: F.trim(F.regexp_replace(s, r"\s+$", ""))), lambda s: s != "")
    step = most - overlap
    cut = lambda s: F.when(F.char_length(s) <= most, F.array(s)).otherwise(F.transform(F.sequence(F.lit(0), F.ceil((F.char_length(s) - overlap) / step).cast("int") - 1), lambda i: F.substring(s, i * step + 1, F.lit(most))))
    units = F.flatten(F.transform(whole, cut))
    state = F.aggregate(
        units, F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now")),
        lambda a, u: F.when((a["now"] != "") & (F.char_length(a["now"]) + F.char_length(u) > most), F.struct(F.array_append(a["done"], a["now"]).alias("done"), u.alias("now"))).otherwise(F.struct(a["done"].alias("done"), F.concat(a["now"], u).alias("now"))),
    )
    return F.when(F.char_length(F.trim(text)) <= most, F.array(F.trim(text))).otherwise(F.array_append(state["done"], state["now"]))


def longest_description(pages: DataFrame, keys: list[str], text: str, order: list[str]) -> DataFrame:
    """Of each key the longest text, the first of equals, and how often the key came."""
    least = [(-F.char_length(text)).alias("_n"), *order, text]
    return pages.groupBy(*keys).agg(F.min(F.struct(*least)).alias("_m"), F.count("*").alias("n")).select(*keys, F.col(f"_m.{text}").alias(text), "n")
