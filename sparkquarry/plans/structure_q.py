"""Queries of Markdown, table and page structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkquarry.functions import boxes as X
from sparkquarry.functions import text as T
from sparkquarry.operators import geometry, markdown, tables
from sparkquarry.plans import common as C
from sparkquarry.sources import load

Q, S = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            S[name] = sql
        return f

    return add


LINES_SQL = rf"""ln AS (SELECT document_name, i - 1 AS line_no, l[i] AS line, regexp_matches(l[i], '^\s*(```|~~~)') AS fence FROM (SELECT document_name, string_split(regexp_replace(markdown, '\r\n?', chr(10), 'g'), chr(10)) AS l FROM ({C.MARKDOWN_SQL})), unnest(range(1, len(l) + 1)) u(i)),
fe AS (SELECT *, fence OR sum(fence::INT) OVER (PARTITION BY document_name ORDER BY line_no) % 2 = 1 AS in_fence, sum(fence::INT) OVER (PARTITION BY document_name ORDER BY line_no) % 2 = 1 AND fence AS opens FROM ln),
lv AS (SELECT *, CASE WHEN in_fence THEN 0 ELSE length(regexp_extract(line, '{markdown.HEADING}', 1)) END AS level, regexp_extract(line, '{markdown.HEADING}', 2) AS title FROM fe)"""


@query("t03_t04_sections", rf"""WITH {LINES_SQL}, h AS (SELECT * FROM lv WHERE level > 0), m AS (SELECT document_name, max(line_no) + 1 AS n FROM lv GROUP BY document_name),
e AS (SELECT a.document_name, a.title, a.level, a.line_no, coalesce(min(b.line_no), any_value(m.n)) AS end_line FROM h a JOIN m USING (document_name) LEFT JOIN h b ON a.document_name = b.document_name AND b.line_no > a.line_no AND b.level <= a.level GROUP BY ALL)
SELECT document_name, regexp_replace(title, '[*`_]+', '', 'g') AS heading, level, line_no AS first_line, end_line FROM e WHERE EXISTS (SELECT 1 FROM lv x WHERE x.document_name = e.document_name AND x.line_no > e.line_no AND x.line_no < e.end_line AND trim(x.line) <> '')""")
def _(s, d):
    return markdown.sections(C.markdown(s, d), "document_name", "markdown")


@query("w16_heading_paths", rf"""WITH {LINES_SQL}, h AS (SELECT * FROM lv WHERE level > 0)
SELECT a.document_name, a.line_no, (SELECT string_agg(b.title, ' > ' ORDER BY b.line_no) FROM h b WHERE b.document_name = a.document_name AND b.line_no <= a.line_no AND NOT EXISTS (SELECT 1 FROM h c WHERE c.document_name = a.document_name AND c.line_no > b.line_no AND c.line_no <= a.line_no AND c.level <= b.level)) AS path FROM h a""")
def _(s, d):
    return markdown.lines(C.markdown(s, d), "document_name", "markdown").where("level > 0").select("document_name", "line_no", F.array_join("path", " > ").alias("path"))


_MANY = "{0} >= greatest(2, floor(n_lines / 2))"
BLOCKS_SQL = rf"""{LINES_SQL}, b0 AS (SELECT *, NOT in_fence AND contains(line, '|') AS piped, NOT (trim(line, ' ') = '' AND NOT in_fence) AND level = 0 AS body FROM lv),
b1 AS (SELECT *, piped AND coalesce(regexp_matches(lead(line) OVER w, '{markdown.DELIMITER}'), FALSE) AND NOT regexp_matches(line, '{markdown.DELIMITER}') AS ts FROM b0 WINDOW w AS (PARTITION BY document_name ORDER BY line_no)),
b2 AS (SELECT *, max(CASE WHEN ts THEN line_no END) OVER w AS lts, max(CASE WHEN NOT piped OR NOT body THEN line_no END) OVER w AS lbr FROM b1 WINDOW w AS (PARTITION BY document_name ORDER BY line_no)),
b3 AS (SELECT *, coalesce(body AND piped AND lts > coalesce(lbr, -1), FALSE) AS tab FROM b2),
b4 AS (SELECT *, body AND (NOT coalesce(lag(body) OVER w, FALSE) OR opens OR coalesce(lag(fence AND NOT opens) OVER w, FALSE) OR ts OR (coalesce(lag(tab) OVER w, FALSE) AND NOT tab)) AS st FROM b3 WINDOW w AS (PARTITION BY document_name ORDER BY line_no)),
b5 AS (SELECT *, sum(st::INT) OVER (PARTITION BY document_name ORDER BY line_no) AS block_no FROM b4),
b6 AS (SELECT document_name, block_no, min(line_no) AS first, count(*) AS n_lines, bool_or(in_fence) AS fenced, bool_or(tab) AS tabled, count_if(regexp_matches(line, '{markdown.LOG}')) AS logs, count_if(regexp_matches(line, '{markdown.SHELL}')) AS cmds FROM b5 WHERE body GROUP BY ALL),
hd AS (SELECT * FROM lv WHERE level > 0),
b7 AS (SELECT b6.*, coalesce((SELECT string_agg(x.title, ' / ' ORDER BY x.line_no) FROM hd x WHERE x.document_name = b6.document_name AND x.line_no <= b6.first AND NOT EXISTS (SELECT 1 FROM hd c WHERE c.document_name = b6.document_name AND c.line_no > x.line_no AND c.line_no <= b6.first AND c.level <= x.level)), '') AS path FROM b6),
bl AS (SELECT document_name, block_no, path, n_lines, CASE WHEN regexp_matches(path, '{markdown.LOW_VALUE}') THEN 'low_value_section' WHEN fenced THEN 'fenced_code' WHEN tabled THEN 'markdown_table' WHEN {_MANY.format('logs')} THEN 'raw_log' WHEN {_MANY.format('cmds')} THEN 'command_list' ELSE 'semantic_prose' END AS reason FROM b7)"""


@query("t01_p15_markdown_blocks", f"WITH {BLOCKS_SQL} SELECT document_name, block_no, path, n_lines, reason FROM bl")
def blocks(s, d):
    return markdown.blocks(C.markdown(s, d), "document_name", "markdown").select("document_name", "block_no", F.array_join("path", " / ").alias("path"), "n_lines", "reason")


@query("a08_router_counts", f"WITH {BLOCKS_SQL} SELECT reason, count(*) AS n, count_if(reason = 'semantic_prose') AS kg, count(DISTINCT document_name) AS documents FROM bl GROUP BY reason")
def _(s, d):
    return blocks(s, d).groupBy("reason").agg(F.count("*").alias("n"), F.count_if(F.col("reason") == "semantic_prose").alias("kg"), F.countDistinct("document_name").alias("documents"))


@query("t02_routed_documents", f"WITH {BLOCKS_SQL} SELECT document_name, CASE WHEN reason = 'semantic_prose' THEN 'kg' ELSE 'text' END AS kind, count(*) AS n_blocks, string_agg(block_no, ',' ORDER BY block_no) AS block_nos FROM bl GROUP BY ALL")
def _(s, d):
    b = markdown.blocks(C.markdown(s, d), "document_name", "markdown")
    return b.groupBy("document_name", "kind").agg(F.count("*").alias("n_blocks"), F.array_join(F.array_sort(F.collect_list("block_no")), ",").alias("block_nos"))


@query("t05_pipe_tables", r"""WITH l AS (SELECT table_uid, i - 1 AS line_no, x[i] AS line FROM (SELECT table_uid, string_split(html, chr(10)) AS x FROM ir_tables WHERE html IS NOT NULL), unnest(range(1, len(x) + 1)) u(i)),
b AS (SELECT *, regexp_matches(line, '^\s*\|.*\|\s*$') AS bar FROM l), g AS (SELECT *, sum((bar AND NOT coalesce(pb, FALSE))::INT) OVER (PARTITION BY table_uid ORDER BY line_no) AS table_no FROM (SELECT *, lag(bar) OVER (PARTITION BY table_uid ORDER BY line_no) AS pb FROM b)),
n AS (SELECT *, row_number() OVER (PARTITION BY table_uid, table_no ORDER BY line_no) AS k FROM g WHERE bar)
SELECT table_uid, table_no, count_if(k > 2 AND NOT regexp_matches(line, '^\s*\|?\s*:?-{2,}')) AS n_rows, array_to_string(list_transform(string_split(regexp_replace(trim(min_by(line, k), ' '), '^\|+|\|+$', '', 'g'), '|'), lambda c: trim(c, ' ')), ' ; ') AS header FROM n GROUP BY ALL HAVING count(*) >= 2""")
def _(s, d):
    t = load(s, d, "ir_tables").where("html is not null")
    return markdown.pipe_tables(t, "table_uid", "html").select("table_uid", "table_no", "n_rows", F.array_join("header", " ; ").alias("header"))


_ROWS = r"""list_transform(regexp_extract_all(regexp_replace(html, '(?i)<tr', '<tr', 'g'), '(?is)<tr[^>]*>((?:[^<]|<[^t/]|<t[^r]|</[^t]|</t[^ra])*)', 1), lambda r: list_transform(regexp_extract_all(r, '(?is)<t[dh][^>]*>((?:[^<]|<[^t/]|<t[^dh]|</[^t]|</t[^dh])*)', 1), lambda c: trim(regexp_replace(regexp_replace(c, '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g'), ' ')))"""


@query("t07_t09_t10_html_rows", f"SELECT table_uid, i - 1 AS row_index, array_to_string(rs[i], ' | ') AS cells, len(rs[i]) = len(rs[1]) AS rectangular FROM (SELECT table_uid, {_ROWS} AS rs FROM ir_tables WHERE regexp_matches(html, '(?i)<tr')), unnest(range(1, len(rs) + 1)) u(i)")
def _(s, d):
    t = load(s, d, "ir_tables").where(F.col("html").rlike("(?i)<tr")).withColumn("rows", tables.html_rows(F.col("html")))
    return t.select("table_uid", F.size(F.get("rows", F.lit(0))).alias("n"), F.posexplode("rows").alias("row_index", "r")).select("table_uid", "row_index", F.array_join("r", " | ").alias("cells"), (F.size("r") == F.col("n")).alias("rectangular"))


@query("t09_row_records", f"SELECT table_uid, i - 2 AS row_index, len(rs[i]) = len(rs[1]) AND len(list_distinct(rs[1])) = len(rs[1]) AS validated, CASE WHEN len(rs[i]) = len(rs[1]) AND len(list_distinct(rs[1])) = len(rs[1]) THEN rs[i][len(rs[1])] END AS last_field FROM (SELECT table_uid, {_ROWS} AS rs FROM ir_tables WHERE regexp_matches(html, '(?i)<tr')), unnest(range(2, len(rs) + 1)) u(i)")
def _(s, d):
    t = load(s, d, "ir_tables").where(F.col("html").rlike("(?i)<tr")).withColumn("rows", tables.html_rows(F.col("html")))
    return tables.row_records(t, "table_uid", "rows").select("table_uid", "row_index", "validated", F.try_element_at(F.map_values("fields"), F.lit(-1)).alias("last_field"))


@query("s13_t11_render_tables", f"SELECT table_uid, md5('| ' || array_to_string(list_transform(rs[1], lambda c: replace(c, '|', ' ')), ' | ') || ' |' || chr(10) || '|' || repeat('---|', len(rs[1])) || array_to_string(list_transform(rs[2:], lambda r: chr(10) || '| ' || array_to_string(list_transform(r, lambda c: replace(c, '|', ' ')), ' | ') || ' |'), '')) AS digest FROM (SELECT table_uid, {_ROWS} AS rs FROM ir_tables WHERE regexp_matches(html, '(?i)<tr'))")
def _(s, d):
    t = load(s, d, "ir_tables").where(F.col("html").rlike("(?i)<tr"))
    return t.select("table_uid", F.md5(tables.render_markdown(tables.html_rows(F.col("html"))).cast("binary")).alias("digest"))


@query("t13_t14_named_rows", f"SELECT table_uid, count_if(contains(lower(heading), lower(rs[i][1]))) AS named FROM (SELECT t.table_uid, b.content_template AS heading, {_ROWS} AS rs FROM ir_tables t JOIN ir_blocks b USING (ir_block_id) WHERE regexp_matches(html, '(?i)<tr') AND b.content_template IS NOT NULL), unnest(range(2, len(rs) + 1)) u(i) WHERE length(rs[i][1]) >= 2 GROUP BY table_uid")
def _(s, d):
    t = load(s, d, "ir_tables").where(F.col("html").rlike("(?i)<tr")).select("table_uid", "ir_block_id", tables.html_rows(F.col("html")).alias("rows"))
    r = tables.row_records(t, "table_uid", "rows").select("table_uid", F.get("cells", F.lit(0)).alias("k")).where(F.char_length("k") >= 2)
    h = load(s, d, "ir_blocks").where("content_template is not null").select("ir_block_id", F.lower("content_template").alias("h"))
    return r.join(t.select("table_uid", "ir_block_id").join(h, "ir_block_id"), "table_uid").groupBy("table_uid").agg(F.count_if(F.contains("h", F.lower("k"))).alias("named"))


@query("t26_section_labels", r"SELECT doc_id, substring(coalesce(nullif(array_to_string(list_filter(content_headings, lambda h: trim(h) <> ''), ' > '), ''), nullif(regexp_extract(text, '(?m)^\s{0,3}#{1,6}\s+(.+?)\s*$', 1), '')), 1, 200) AS label FROM documents")
def _(s, d):
    return load(s, d, "documents").select("doc_id", T.section_label(F.col("content_headings"), F.col("text")).alias("label"))


@query("t28_cited_passage", "SELECT doc_id, instr(text, 'the') - 1 AS before, length(text) - instr(text, 'the') - 2 AS after FROM documents WHERE contains(text, 'the')")
def _(s, d):
    at = F.instr("text", "the")
    return load(s, d, "documents").where("contains(text, 'the')").select("doc_id", (at - 1).cast("bigint").alias("before"), (F.char_length("text") - at - 2).cast("bigint").alias("after"))




def _overlap(a: str, b: str) -> str:
    return f"greatest(0, least({a}.x1::DOUBLE, {b}.x1) - greatest({a}.x0::DOUBLE, {b}.x0)) * greatest(0, least({a}.y1::DOUBLE, {b}.y1) - greatest({a}.y0::DOUBLE, {b}.y0))"


def _center(a: str, b: str) -> str:
    return f"(({a}.x0::DOUBLE + {a}.x1) / 2 BETWEEN {b}.x0 AND {b}.x1 AND ({a}.y0::DOUBLE + {a}.y1) / 2 BETWEEN {b}.y0 AND {b}.y1)"


def _inside(a: str, b: str) -> str:
    return f"({_center(a, b)} OR coalesce({_overlap(a, b)} / nullif(greatest(0, {a}.x1::DOUBLE - {a}.x0) * greatest(0, {a}.y1::DOUBLE - {a}.y0), 0) >= 0.5, FALSE))"


def _best(items: str, item: str, order: str) -> str:
    return f"SELECT i.{item}, p.block_id AS region_id FROM {items} i LEFT JOIN (SELECT {item}, block_id FROM (SELECT i.{item}, b.block_id, {_overlap('i', 'b')} AS area, b.reading_order, {_center('i', 'b')} AS c FROM {items} i JOIN blocks b USING (page_uid)) WHERE area > 0 QUALIFY row_number() OVER (PARTITION BY {item} ORDER BY {order}) = 1) p USING ({item})"


@query("j11_glyph_to_cell", _best("native_glyphs", "glyph_id", "c DESC, area DESC, reading_order DESC, block_id DESC"))
def _(s, d):
    return geometry.best_region(load(s, d, "native_glyphs"), "glyph_id", load(s, d, "blocks"), "block_id", "reading_order", center_first=True)


@query("j12_glyph_to_region", _best("native_glyphs", "glyph_id", "area DESC, reading_order, block_id"))
def _(s, d):
    return geometry.best_region(load(s, d, "native_glyphs"), "glyph_id", load(s, d, "blocks"), "block_id", "reading_order")


@query("j13_ocr_to_layout", _best("ocr_texts", "ocr_id", "area DESC, reading_order, block_id"))
def _(s, d):
    return geometry.best_region(load(s, d, "ocr_texts"), "ocr_id", load(s, d, "blocks"), "block_id", "reading_order")


@query("j14_blocks_outside_tables", f"SELECT block_id FROM blocks b WHERE label <> 'table' AND NOT EXISTS (SELECT 1 FROM blocks t WHERE t.label = 'table' AND t.page_uid = b.page_uid AND {_inside('b', 't')})")
def _(s, d):
    b = load(s, d, "blocks")
    return geometry.outside(b.where("label <> 'table'"), "block_id", b.where("label = 'table'"), "block_id").select("block_id")


@query("j15_table_order", f"SELECT t.block_id, coalesce(min(CASE WHEN {_inside('b', 't')} THEN b.reading_order END), count_if(b.y0 < t.y0)) AS reading_order FROM blocks t LEFT JOIN blocks b ON b.page_uid = t.page_uid AND b.label <> 'table' WHERE t.label = 'table' GROUP BY t.block_id")
def _(s, d):
    b = load(s, d, "blocks")
    others = b.where("label <> 'table'").withColumnRenamed("block_id", "other_id")
    return geometry.table_order(b.where("label = 'table'"), "block_id", others, "other_id")


@query("j16_ocr_text_in_blocks", f"SELECT b.block_id, string_agg(o.text, ' ' ORDER BY o.line_index, o.text) AS text FROM ocr_texts o JOIN blocks b ON b.page_uid = o.page_uid AND {_center('o', 'b')} WHERE o.text IS NOT NULL GROUP BY b.block_id")
def _(s, d):
    return geometry.text_in_regions(load(s, d, "ocr_texts"), "line_index", load(s, d, "blocks"), "block_id")


@query("w15_reading_order", "SELECT page_uid, block_id, row_number() OVER (PARTITION BY page_uid ORDER BY (y0::DOUBLE + y1) / 2, x0, block_id) - 1 AS position FROM blocks")
def _(s, d):
    return geometry.reading_order(load(s, d, "blocks"), "block_id")


@query("w14_region_suppression")
def _(s, d):
    return geometry.suppress(load(s, d, "blocks"), "block_id", "layout_score")


@query("a19_cell_rows")
def _(s, d):
    return geometry.row_clusters(load(s, d, "blocks"), "block_id")


@query("a20_a21_a22_visual_lines")
def _(s, d):
    g = load(s, d, "native_glyphs")
    return geometry.line_texts(g.join(geometry.visual_lines(g), ["page_uid", "glyph_id"]))


@query("a23_grid_size", f"SELECT table_uid, len(rs) AS n_rows, list_max(list_transform(rs, lambda r: len(r))) AS n_cols FROM (SELECT table_uid, {_ROWS} AS rs FROM ir_tables WHERE regexp_matches(html, '(?i)<tr'))")
def _(s, d):
    t = load(s, d, "ir_tables").where(F.col("html").rlike("(?i)<tr")).select("table_uid", F.posexplode(tables.html_rows(F.col("html"))).alias("r", "cells"))
    return t.groupBy("table_uid").agg((F.max("r") + 1).cast("bigint").alias("n_rows"), F.max(F.size("cells")).cast("bigint").alias("n_cols"))


@query("a24_glyph_text", "SELECT page_uid, string_agg(CASE WHEN space_before THEN ' ' ELSE '' END || text, '' ORDER BY glyph_index) AS text FROM native_glyphs WHERE text IS NOT NULL GROUP BY page_uid")
def _(s, d):
    piece = F.concat(F.when(F.col("space_before"), " ").otherwise(""), "text")
    g = load(s, d, "native_glyphs").where("text is not null").groupBy("page_uid").agg(F.array_sort(F.collect_list(F.struct("glyph_index", piece.alias("p")))).alias("g"))
    return g.select("page_uid", F.array_join(F.transform("g", lambda x: x["p"]), "").alias("text"))


@query("t33_t34_t35_page_boxes", "SELECT b.block_id, round(greatest(0, x0::DOUBLE - pad), 4) AS px0, round(least(width, x1::DOUBLE + pad), 4) AS px1, round(x0::DOUBLE * dpi / 72.0, 4) AS ix0, round(height - y1::DOUBLE * (dpi / 72.0), 4) AS iy0 FROM (SELECT *, greatest(6.0, round(least(p.width, p.height) * 0.004)) AS pad FROM blocks JOIN parsed_pages p USING (page_uid)) b")
def _(s, d):
    p = load(s, d, "parsed_pages").select("page_uid", "width", "height", "dpi")
    b = load(s, d, "blocks").join(p, "page_uid")
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    pad, pix = X.padded(X.box(), w, h), X.to_pixels(X.box(), F.col("dpi"), h)
    return b.select("block_id", F.round(pad[0], 4).alias("px0"), F.round(pad[2], 4).alias("px1"), F.round(pix[0], 4).alias("ix0"), F.round(pix[1], 4).alias("iy0"))


@query("t36_parse_route", r"SELECT page_uid, CASE WHEN length(regexp_replace(coalesce(native_text, ''), '[ \t\n\r\f]+', '', 'g')) >= 80 THEN 'pdfium_layout' ELSE 'vision_fusion' END AS route FROM parsed_pages")
def _(s, d):
    n = F.char_length(F.regexp_replace(F.coalesce("native_text", F.lit("")), r"[ \t\n\r\f]+", ""))
    return load(s, d, "parsed_pages").select("page_uid", F.when(n >= 80, "pdfium_layout").otherwise("vision_fusion").alias("route"))


@query("t37_enriched_markdown", "SELECT page_uid, md5('## Page ' || page || string_agg(chr(10) || CASE WHEN label = 'title' THEN '### ' ELSE '' END || b.text, '' ORDER BY reading_order, block_id)) AS digest FROM blocks b JOIN parsed_pages p USING (page_uid) WHERE b.text IS NOT NULL GROUP BY page_uid, page")
def _(s, d):
    b = load(s, d, "blocks").where("text is not null").select("page_uid", F.struct("reading_order", "block_id", F.concat(F.lit("\n"), F.when(F.col("label") == "title", "### ").otherwise(""), "text").alias("t")).alias("x"))
    g = b.groupBy("page_uid").agg(F.array_sort(F.collect_list("x")).alias("xs")).join(load(s, d, "parsed_pages").select("page_uid", "page"), "page_uid")
    return g.select("page_uid", F.md5(F.concat(F.lit("## Page "), F.col("page").cast("string"), F.array_join(F.transform("xs", lambda x: x["t"]), "")).cast("binary")).alias("digest"))


@query("f32_extraction_windows")
def _(s, d):
    return C.chunks(s, d).select("chunk_id", F.posexplode(markdown.extraction_windows(F.col("content"))).alias("window_no", "text"))


@query("a18_longest_description", "SELECT page_uid, label, text, n FROM (SELECT *, row_number() OVER (PARTITION BY page_uid, label ORDER BY length(text) DESC, reading_order, block_id, text) AS k, count(*) OVER (PARTITION BY page_uid, label) AS n FROM blocks WHERE text IS NOT NULL) WHERE k = 1")
def _(s, d):
    return markdown.longest_description(load(s, d, "blocks").where("text is not null"), ["page_uid", "label"], "text", ["reading_order", "block_id"])
